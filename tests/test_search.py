from __future__ import annotations

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.functions import text
from lodestone.operators import dense, evaluation, fusion, graph, lexical, suggest

DOCS = "seq long, symbol string, code string, doc int, term string"


def column(spark, function, *values):
    return [r.x for r in spark.createDataFrame([(v,) for v in values], "v string").select(function(F.col("v")).alias("x")).collect()]


def test_identifiers_are_split(spark):
    given_ = ["getUserById", "JWT_SECRET", "HTTPServer", "VectorStore", "snake_case_name", "a.b.c", "plain", "", None]
    assert column(spark, text.split_identifiers, *given_) == ["get user by id", "jwt secret", "http server", "vector store", "snake case name", "a b c", "plain", "", None]


def test_words_fold_case_and_accents(spark):
    assert column(spark, text.words, "Où ÉTAIT l’Ärger_2?", "", None) == [["ou", "etait", "l", "arger", "2"], [], []]


def test_query_columns(spark):
    assert column(spark, text.query_terms, "where is getUser?", None) == [["where", "is", "getuser", "get", "user"], []]
    assert column(spark, text.query_symbols, "call Store.load in src/x.ts a") == [["call", "Store.load", "in", "src/x.ts"]]
    assert column(spark, text.significant_terms, "how does the rank fusion work work") == [["rank", "fusion", "work"]]
    assert column(spark, text.identifier_key, "getUserById", "by_id_user_get") == ["by get id user", "by get id user"]


def bm25(tf, n, size, avg, docs):
    idf = math.log((docs - n + 0.5) / (n + 0.5))
    return (idf if idf > 0 else 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / avg))


def test_bm25_by_hand_with_phrase(spark):
    docs = [(1, "loadToken", "jwt secret here", 0, "t"), (2, "x", "secret of jwt", 0, "t"), (3, "y", None, 0, "t"), (1, "loadToken", "jwt secret here", 0, "t"), (4, None, "filler words only", 0, "t")]
    index = lexical.indexed(spark.createDataFrame(docs, DOCS))
    queries = spark.createDataFrame([(7, "jwt_secret"), (8, "???"), (9, None), (10, "token")], "query_id long, query_text string")
    got = {(r.query_id, r.doc): r.score for r in lexical.search(lexical.postings(index), index, queries).collect()}
    sizes = {1: 6, 2: 5, 3: 2, 4: 3}  # loadtoken load token + jwt secret here; x x ...; y y
    avg = sum(sizes.values()) / 4
    both = lambda d: bm25(1, 2, sizes[d], avg, 4)
    assert got[7, 1] == pytest.approx(2 * both(1) + bm25(1, 1, 6, avg, 4))
    assert got[7, 2] == pytest.approx(2 * both(2))
    assert set(got) == {(7, 1), (7, 2), (10, 1)}


def test_search_of_nothing(spark):
    index = lexical.indexed(spark.createDataFrame([], DOCS))
    assert lexical.search(lexical.postings(index), index, spark.createDataFrame([(1, "a")], "query_id long, query_text string")).count() == 0


def test_cosine_and_vector_search(spark):
    rng = np.random.default_rng(2)
    points = rng.normal(size=(60, 8))
    data = [(k, [float(x) for x in p]) for k, p in enumerate(points)] + [(100, None), (101, [0.0] * 8), (102, [1.0] * 7)]
    vectors = spark.createDataFrame(data, "id long, vector array<float>")
    queries = vectors.filter("id < 5").withColumnRenamed("id", "query_id")
    got = {(r.query_id, r["rank"]): r.id for r in dense.search(vectors, queries, 3, 8).collect()}
    unit = points / np.linalg.norm(points, axis=1)[:, None]
    for q in range(5):
        assert [got[q, k] for k in (1, 2, 3)] == list(np.argsort(-(unit @ unit[q]))[:3])
    with pytest.raises(Exception, match="different length"):
        vectors.filter("id in (1, 102)").select(dense.cosine(F.col("vector"), F.array(*[F.lit(1.0)] * 8))).collect()
    assert dense.search(vectors.limit(0), queries, 3, 8).count() == 0


def test_rank_fusion_by_hand(spark):
    leg = lambda rows: spark.createDataFrame(rows, "query_id long, doc long, rank int")
    fused = fusion.fuse({"bm25": leg([(1, 10, 1), (1, 11, 2)]), "structural": leg([(1, 11, 1), (1, 11, 3)])})
    got = {r.doc: (r.bm25, r.structural, r.fused) for r in fused.collect()}
    assert got[10] == pytest.approx((0.6 / 61, 0, 0.6 / 61))
    assert got[11] == pytest.approx((0.6 / 62, 0.3 / 61 + 0.3 / 63, 0.6 / 62 + 0.3 / 61 + 0.3 / 63))


def test_late_definitions_take_the_last_places(spark):
    fused = spark.createDataFrame([(1, d, 1.0 / d) for d in range(1, 16)], "query_id long, doc long, fused double")
    defined = spark.createDataFrame([(1, 13, 1), (1, 10, 2)], "query_id long, doc long, pin int")
    got = [r.doc for r in fusion.guaranteed(fused, defined, 10).orderBy("rank").collect()]
    assert got == [1, 2, 3, 4, 5, 6, 7, 8, 9, 13]


CHUNK = "seq long, repo string, path string, symbol string, structural_refs struct<calls:array<string>,imports:array<string>>"


def test_graph_prefers_imported_definers(spark):
    chunks = spark.createDataFrame(
        [
            (1, "r", "src/a.ts", "main", (["load", "gone", "main"], ["./b.js"])), (2, "r", "src/b.ts", "B.load", ([], [])), (3, "r", "src/c.ts", "C.load", ([], [])),
            (4, "r", "src/d.ts", "other", (["load"], ["./nowhere", "bare"])), (5, "q", "src/b.ts", "B.load", (None, None)), (6, "r", "src/e.ts", "x", None),
        ],
        CHUNK,
    )
    nodes = graph.nodes(chunks)
    links = {(r.src, r.kind, r.name, r.dst) for r in graph.links(nodes).collect()}
    assert links == {(1, "pair", "load", 2), (1, "exact", "main", None), (1, "file", "src/b", None), (4, "short", "load", None)}
    seeded = spark.createDataFrame([(9, 2), (9, 4), (9, 77)], "query_id long, seed long")
    near = {(r.doc, r.score) for r in graph.expand(seeded, graph.links(nodes), graph.members(nodes)).collect()}
    assert near == {(1, 1), (3, 1)}


def test_definitions_and_pins(spark):
    chunks = spark.createDataFrame([(1, "r", "a.ts", "Store.load", None), (2, "r", "b.ts", "save", None), (3, "q", "c.ts", "save", None)], CHUNK)
    queries = spark.createDataFrame([(1, "does save call Other.load or load"), (2, "nothing")], "query_id long, query_text string")
    defined = graph.definitions(queries, graph.nodes(chunks))
    assert [(r.doc, r.pin) for r in defined.orderBy("pin").collect()] == [(2, 1), (3, 2), (1, 3)]
    expanded = spark.createDataFrame([(1, 3, 4), (1, 50, 2)], "query_id long, doc long, score long")
    assert {(r.doc, r.score) for r in graph.pinned(expanded, defined).collect()} == {(2, 7), (3, 6), (1, 5), (50, 2)}


def test_near_misses(spark):
    symbols = spark.createDataFrame([("VectorStore",), ("vectorStorage",), ("rankFusion",), (None,), ("abc",)], "symbol string")
    queries = spark.createDataFrame([(1, "where is VectorStor kept"), (2, "see rankFusion"), (3, "`zzzzqqqq`"), (4, None)], "query_id long, query_text string")
    assert [(r.query_id, r.symbol) for r in suggest.nearest_symbols(queries, symbols).collect()] == [(1, "VectorStore")]


def test_citations(spark):
    rows = spark.createDataFrame([(1, "see [a] and [b] [a]", ["a"]), (2, "see [a]", ["a"]), (3, "none", ["a"]), (4, None, None)], "query_id long, answer string, known array<string>")
    assert {r.query_id: (r.known, r.unknown, r.ok) for r in fusion.checked_citations(rows).collect()} == {1: (1, 1, False), 2: (1, 0, True), 3: (0, 0, False), 4: (0, 0, False)}


@settings(max_examples=10, deadline=None)
@given(st.data())
def test_quality_scores_equal_their_definition(spark, data):
    ranking = data.draw(st.lists(st.integers(1, 8), max_size=12))
    relevant = data.draw(st.sets(st.integers(1, 10), min_size=1))
    k = data.draw(st.integers(-1, 9))
    ranked = spark.createDataFrame([(1, d, i + 1) for i, d in enumerate(ranking)], "query_id long, doc long, rank int")
    got = evaluation.scores(ranked, spark.createDataFrame([(1, d) for d in relevant], "query_id long, doc long"), k).first()
    once = list(dict.fromkeys(ranking))[: max(k, 0)]
    dcg = sum(1 / math.log2(i + 2) for i, d in enumerate(once) if d in relevant)
    ideal = sum(1 / math.log2(i + 2) for i in range(min(len(relevant), max(k, 0))))
    first = next((i + 1 for i, d in enumerate(ranking) if d in relevant), None)
    assert (got.recall, got.rr, got.ndcg) == pytest.approx((len(set(once) & relevant) / len(relevant) if k > 0 else 0, 1 / first if first else 0, dcg / ideal if ideal else 0))
    assert 0 <= got.ndcg <= 1 + 1e-9


def test_regressions(spark):
    base = spark.createDataFrame([("a", 1.0), ("b", 0.5), ("c", 0.5)], "metric string, value double")
    now = spark.createDataFrame([("a", 1.0), ("b", float("nan"))], "metric string, value double")
    assert {r.metric for r in evaluation.regressions(now, base).collect()} == {"b", "c"}
