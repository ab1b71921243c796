from __future__ import annotations

import pytest

from helpers import SMALL
from lodestone.operators import dense, fusion
from lodestone.plans import hybrid


def test_near_vectors_ground_a_query_without_its_words(spark):
    chunks = spark.createDataFrame([(k, f"{k}.ts", "store", "rank fusion") for k in range(1, 6)], "seq long, path string, symbol string, code string")
    queries = spark.createDataFrame([(1, "walk of penguins"), (2, "walk of penguins"), (3, "walk of penguins"), (4, "fusion of ranks"), (5, "walk of penguins"), (6, "walk of penguins")], "query_id long, query_text string")
    rows = [(1, 1, 1, None), (1, 2, 3, 0.27), (2, 1, 1, 0.2699996), (2, 2, 4, 0.9), (3, 1, 1, None), (4, 1, 1, -0.5), (5, 1, 1, -0.5), (5, 2, 2, -0.25)]
    results = spark.createDataFrame(rows, "query_id long, doc long, rank int, cosine double")
    got = {r.query_id: (r.lexical, r.semantic, r.band) for r in fusion.grounding(results, queries, chunks).collect()}
    assert got == {1: (0.0, 0.27, "answer"), 2: (0.0, 0.2699996, "refuse"), 3: (0.0, 0.0, "refuse"), 4: (0.5, -0.5, "answer"), 5: (0.0, -0.25, "refuse"), 6: (0.0, 0.0, "refuse")}
    bare = {r.query_id: r.band for r in fusion.grounding(results.drop("cosine"), queries, chunks).collect()}
    assert bare == {1: "refuse", 2: "refuse", 3: "refuse", 4: "answer", 5: "refuse", 6: "refuse"}


def test_telemetry_of_results(spark):
    chunks = spark.createDataFrame([(1, "a.ts"), (2, "b.ts"), (3, "a.ts")], "seq long, path string")
    queries = spark.createDataFrame([(1, "x"), (2, "y")], "query_id long, query_text string")
    results = spark.createDataFrame([(1, 2, 2, 0.1, 0.0, 0.3), (1, 1, 1, 0.5, 0.2, 0.0), (1, 3, 3, 0.1, 0.0, 0.0)], "query_id long, doc long, rank int, bm25 double, dense double, structural double")
    got = {r.query_id: tuple(r)[1:] for r in fusion.telemetry(results, queries, chunks).collect()}
    assert got == {1: (3, 0.5, 0.2, 0.0, ["a.ts", "b.ts"]), 2: (0, 0.0, 0.0, 0.0, [])}


def test_a_large_query_set_is_cut_into_blocks(spark, monkeypatch):
    rows = spark.createDataFrame([(k, [float(k % 3), 1.0, float(k % 5)]) for k in range(30)], "id long, vector array<double>")
    queries = rows.limit(4).withColumnRenamed("id", "query_id")
    take = lambda: sorted(tuple(r) for r in dense.search(rows, queries, 3, 3).select("query_id", "id", "rank").collect())
    sent = take()
    monkeypatch.setattr(dense, "MOST_BYTES", 0)
    assert take() == sent and len(sent) == 12


def test_a_leg_that_fails_is_left_out(spark):
    kind = "query_id long, doc long, rank int, cosine double"
    assert fusion.safely(lambda: 1 / 0, spark, kind).count() == 0
    assert fusion.safely(lambda: spark.createDataFrame([(1, 2, 1, 0.5)], kind), spark, kind).count() == 1


@pytest.mark.parametrize("name", ["context_assembly", "grounding_gate", "hybrid_gate", "hybrid_search", "one_hop_expand", "retrieve_topk", "rrf_fuse"])
def test_a_query_fails_with_its_vectors(spark, monkeypatch, name):
    def broken(*_, **__):
        raise RuntimeError("no vectors")

    monkeypatch.setattr(dense, "search", broken)
    with pytest.raises(RuntimeError, match="no vectors"):
        hybrid.QUERIES[name](spark, SMALL)
