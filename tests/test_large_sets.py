"""Searches of large query sets, and what they may not do: shuffle pairs of query and row."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa

from lodestone.operators import corpus as files
from lodestone.operators import dense, fusion, graph, lexical, suggest
from lodestone.sources import tables

QUERIES = "query_id long, query_text string"


def corpus(spark, n=300):
    rng = random.Random(5)
    words = ["load", "token", "user_id", "cache", "render", "the", "jwt secret", "été", "x2"]
    docs = [(k, rng.choice(["loadToken", "user_id", None, "Store.load"]), " ".join(rng.choices(words, k=rng.randrange(12))), 0, "") for k in range(n)]
    asked = [(k, rng.choice(["how does ", "", "the "]) + " ".join(rng.choices(["jwt_secret", "loadToken", "user_id", "ete", "été", "cache", "x2_the", "nothing"], k=rng.randrange(4)))) for k in range(60)]
    return lexical.indexed(spark.createDataFrame(docs + docs[:9], "seq long, symbol string, code string, doc int, term string")), spark.createDataFrame(asked + [(900, None), (901, "??")], QUERIES)


def rows(df):
    return {(r.query_id, r["rank"]): (r.doc, round(r.score, 9)) for r in df.collect()}


def test_a_large_query_set_is_answered_like_a_look_up(spark, monkeypatch):
    tokens, queries = corpus(spark)
    expected = rows(lexical.search(lexical.postings(tokens), tokens, queries, 7))
    assert len(expected) > 100
    assert rows(lexical.search_all(tokens, queries, 7)) == expected
    monkeypatch.setattr(lexical, "MOST_TERMS", 40)  # several slices
    assert rows(lexical.search_all(tokens, queries, 7)) == expected
    assert lexical.search_all(tokens.limit(0), queries).count() == 0
    assert lexical.search_all(tokens, queries.limit(0)).count() == 0


def test_no_pair_of_query_and_document_is_shuffled(spark):
    tokens, queries = corpus(spark)
    found = lexical.search_all(tokens, queries, 7)
    assert found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") > 0 and "Generate" not in plan and "SortMergeJoin" not in plan


def test_vectors_stay_where_they_are_for_a_large_query_set(spark, monkeypatch):
    rng = np.random.default_rng(3)
    points = rng.integers(0, 3, size=(500, 6)).astype(float)  # many ties, some zero vectors
    vectors = spark.createDataFrame([(k, p.tolist()) for k, p in enumerate(points)], "id long, vector array<double>").repartition(3)
    queries = vectors.filter("id < 90").withColumnRenamed("id", "query_id")
    monkeypatch.setattr(dense, "MOST_BYTES", 1500)
    monkeypatch.setattr(dense, "FIRST", 20)
    found = dense.search(vectors, queries, 5, 6, unique=True)
    unit = points / np.maximum(np.linalg.norm(points, axis=1), 1e-300)[:, None]
    got = {(r.query_id, r["rank"]): r.id for r in found.collect()}
    for q in range(90):
        assert [got[q, k] for k in range(1, 6)] == np.lexsort((np.arange(500), -(unit @ unit[q]).round(9)))[:5].tolist()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroups" not in plan and "Generate" not in plan


def test_fused_rows_move_once(spark):
    leg = lambda *cells: spark.createDataFrame(list(cells), "query_id long, doc long, rank int")
    near = spark.createDataFrame([(1, 5, 1, 0.9)], "query_id long, doc long, rank int, cosine double")
    fused = fusion.fuse({"bm25": leg((1, 5, 1), (2, 6, 1)), "dense": near, "structural": leg((1, 7, 1))})
    assert {(r.query_id, r.doc): r.cosine for r in fused.collect()} == {(1, 5): 0.9, (2, 6): None, (1, 7): None}
    defined = spark.createDataFrame([(1, 7, 1)], "query_id long, doc long, pin int")
    out = fusion.guaranteed(fused, defined.hint("broadcast"), 1)
    assert {(r.query_id, r.doc) for r in out.collect()} == {(1, 7), (2, 6)}
    assert out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("Exchange hashpartitioning") == 1


def test_exploded_names_are_never_broadcast(spark):
    symbols = spark.createDataFrame([(f"loadToken{k}", f"src/{k}.ts") for k in range(40)], "symbol string, path string")
    typed = spark.createDataFrame([(1, "loadT"), (2, "loadT"), (3, "no")], "query_id long, typed string")
    done = files.complete(symbols, typed)
    found = done.collect()
    assert {r.query_id for r in found} == {1, 2} and len(found) == 16
    assert "strategy=broadcast" in done._jdf.queryExecution().analyzed().toString()
    near = suggest.nearest_symbols(spark.createDataFrame([(1, "where is loadTokn7")], "query_id long, query_text string"), symbols)
    assert [r.symbol for r in near.collect()] == ["loadToken7"]
    plan = near._jdf.queryExecution().analyzed().toString()
    assert plan.count("strategy=merge") >= 2 and "strategy=broadcast" in plan


def graph_and_seeds(spark):
    rng = random.Random(9)
    names = ["load", "Store.load", "Pool.load", "save", "Store.save", "run", "main"]
    refs = lambda: (rng.sample(["load", "save", "run", "main", "nothing"], rng.randrange(4)), [f"./f{rng.randrange(6)}" for _ in range(rng.randrange(2))])
    chunks = [(k, rng.choice(["r", "r", "s", None]), f"a/f{rng.randrange(8)}.ts", rng.choice([*names, None]), refs()) for k in range(120)]
    nodes = graph.nodes(spark.createDataFrame(chunks, "seq long, repo string, path string, symbol string, structural_refs struct<calls:array<string>,imports:array<string>>"))
    seeds = [(q, s) for q in range(40) for s in rng.sample(range(130), rng.randrange(1, 6))]
    seeds += [(q + 100, s) for q, s in seeds if q < 9]  # queries of the same seeds
    return graph.links(nodes), graph.members(nodes), seeds, spark.createDataFrame(seeds, "query_id long, seed long")


def by_hand(linked, known, seeds):
    near, keys = {}, {}
    for r in known.collect():
        keys.setdefault((r.repo, r.kind, r.name), []).append(r.dst)
    for r in linked.collect():
        for dst in [r.dst] if r.kind == "pair" else keys.get((r.repo, r.kind, r.name), []) if r.repo else []:
            near.setdefault(r.src, set()).add(dst)
            near.setdefault(dst, set()).add(r.src)
    found = {}
    for q, s in seeds:
        for d in near.get(s, ()):
            if (q, d) not in seeds:
                found[q, d] = found.get((q, d), 0) + 1
    return found


def test_neighbours_are_counted_where_the_chunks_are(spark, monkeypatch):
    linked, known, seeds, seeded = graph_and_seeds(spark)
    assert linked.filter("kind = 'pair'").count() and linked.filter("kind = 'file'").count()
    expected = by_hand(linked, known, seeds)

    def check():
        near = graph.expand(seeded, linked, known)
        assert {(r.query_id, r.doc): r.score for r in near.collect()} == expected and near.count() == len(expected) > 1000
        plan = near._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert "Exchange hashpartitioning(query_id" not in plan and "Exchange hashpartitioning(doc" in plan and "Aggregate" not in plan

    check()
    monkeypatch.setattr(graph, "MOST", 90)  # several slices of the queries
    check()
    assert graph.expand(seeded.limit(0), linked, known).count() == 0


def test_chunks_of_many_ends_are_counted_in_blocks(spark, monkeypatch):
    linked, known, seeds, seeded = graph_and_seeds(spark)
    reach = graph.reach(seeded, linked, known)
    asked = graph._Asked(reach.touching[0].toArrow())
    assert asked.count < len(asked.same)
    rows = sorted((r.node, r.end ^ 1) for r in reach.ends.collect())
    batches = [pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows[k : k + 7]], pa.int64()) for i in (0, 1)], names=["doc", "end"]) for k in range(0, len(rows), 7)]
    for block in (1, 50, 10**6):
        monkeypatch.setattr(graph, "BLOCK", block)
        blocks = list(asked.neighbours(iter(batches)))
        assert (len(blocks) > 1) == (block < 10**6)
        got = {(a, d): n for own in blocks for a, d, n in zip(*own)}
        stands = zip(asked.same.column("asked").to_pylist(), asked.same.column("query_id").to_pylist())
        assert {(q, d): n for a, q in stands for (b, d), n in got.items() if a == b} == by_hand(linked, known, seeds)


def test_texts_that_do_not_repeat_stay_where_they_are(spark):
    rows = [(k, "loadToken", f"text {k}") for k in range(50)] + [(7, "loadToken", "text 7"), (None, "x", "y")]
    chunks = spark.createDataFrame(rows, "seq long, symbol string, code string")
    for most in (0, 200_000):
        kept = tables.once(chunks, "seq", most)
        assert sorted(kept.collect()) == sorted((k, "loadToken", f"text {k}") for k in range(50))
    tokens = lexical.indexed(chunks)
    assert tokens.count() == 50 and tokens.collect()
    plan = tokens._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "LeftAnti" in plan and plan.count("Exchange hashpartitioning") == 1 and "LeftSemi" in plan


def test_definitions_stand_above_neighbours_without_counting_them_twice(spark):
    linked, known, seeds, seeded = graph_and_seeds(spark)
    near = by_hand(linked, known, seeds)
    top = {q: max(n for (p, _), n in near.items() if p == q) for q, _ in near}
    reach = graph.reach(seeded, linked, known)
    assert {r.query_id: r.top for r in reach.top().collect()} == top
    defined = spark.createDataFrame([(q, d, pin) for q in (0, 1, 103, 999) for pin, d in ((1, 5), (2, 500))], "query_id long, doc long, pin int")
    pinned = graph.pinned(reach.expanded(), defined.hint("broadcast"), reach.top())
    expected = {k: n for k, n in near.items() if k[1] != 5 or k[0] not in (0, 1, 103)} | {(q, d): top.get(q, 0) + 3 - pin for q in (0, 1, 103, 999) for pin, d in ((1, 5), (2, 500))}
    assert {(r.query_id, r.doc): r.score for r in pinned.collect()} == expected
    plan = pinned._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("MapInArrow") == 2 and "max(score" not in plan


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_nearest_names_are_found_at_any_distance(spark):
    rng = random.Random(1)
    word = lambda lo, hi: "".join(rng.choices("abc"[: rng.choice((2, 3))], k=rng.randrange(lo, hi)))
    names = sorted({word(1, 14) for _ in range(120)} | {word(20, 45) for _ in range(60)})

    def changed(name, times):
        for _ in range(times):
            at, kind = rng.randrange(len(name) + 1), rng.randrange(3)
            name = name[:at] + ("" if kind == 0 else rng.choice("abcx")) + name[at + (kind < 2) :]
        return name

    keys = sorted({changed(rng.choice(names), rng.choice((0, 1, 2, 3, 5, 8, 12))) for _ in range(150)} - {""})
    expected = set()
    for a in keys:
        far = {b: edit_distance(a, b) / max(len(a), len(b)) for b in names}
        least = min(far.values())
        expected |= {(a, b, round(x, 9)) for b, x in far.items() if round(x, 9) == round(least, 9) and x <= suggest.FARTHEST}
    assert max(edit_distance(a, b) for a, b, _ in expected) > 4  # several rounds
    got = suggest._nearest(spark.createDataFrame([(k,) for k in keys], "a string"), spark.createDataFrame([(k,) for k in names], "b string")).collect()
    assert {(r.a, r.b, round(r.distance, 9)) for r in got} == expected and len(got) == len(expected)


def test_names_of_common_parts_are_not_compared_with_each_other(spark):
    rng = random.Random(2)
    names = sorted({f"{''.join(rng.choice('bdfgklmnprstvz') + rng.choice('aeiou') for _ in range(4))} {rng.choice(['scan', 'report trim'])}" for _ in range(2000)})
    keys = [n[:-1] for n in names[::4]]
    frame = lambda values, name: spark.createDataFrame([(v,) for v in values], f"{name} string")
    pairs = suggest._stored(frame(names, "b"), 1).join(suggest._wanted(frame(keys, "a"), 1), suggest._PIECE).select("a", "b").collect()
    assert {(k, n) for k, n in zip(keys, names[::4])} <= {tuple(r) for r in pairs} and len(pairs) < 2 * len(keys)
    assert len(suggest._nearest(frame(keys, "a"), frame(names, "b")).select("a").distinct().collect()) == len(keys)
