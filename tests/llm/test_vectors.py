from __future__ import annotations

import numpy as np
import pytest

from lodestone.llm import neighbours as N

KIND = "chunk_id string, vector array<float>, cell int, shard int, tau double, top string"


def frame(spark, rows):
    return N.usable(spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, 2, 3.0, "t") for i, v in rows], KIND), 8)


def clusters(n, seed=3, dim=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    points = centres[rng.choice(12, n, p=np.r_[[0.4], [0.6 / 11] * 11])] + 0.3 * rng.normal(size=(n, dim))
    return [(f"c{k:04d}", p * rng.uniform(0.2, 5)) for k, p in enumerate(points)]


def brute(rows, queries, k):
    ids = np.array([i for i, _ in rows])
    unit = np.float32(np.array([v for _, v in rows])).astype(float)
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    out = set()
    for q in queries:
        s = -(unit @ unit[list(ids).index(q)])
        out |= {(q, o) for o in [ids[j] for j in np.lexsort((ids, s.round(12))) if ids[j] != q][:k]}
    return out


@pytest.mark.parametrize("relax,least", [(1.0, 1.0), (N.RELAX, 0.97)])
def test_recall_against_brute_force(spark, relax, least):
    rows = clusters(1500)
    queries = [i for i, _ in rows[::50]]
    vectors = frame(spark, rows)
    asked = vectors.join(spark.createDataFrame([(q,) for q in queries], "id string"), "id", "left_semi")
    got = {(r.id, r.other) for r in N.nearest(asked, vectors, 10, 8, relax, shard=128).collect()}
    true = brute(rows, queries, 10)
    assert len(got) == len(true) and len(got & true) >= least * len(true)


def test_both_passes_meet_every_shard(spark):
    """As many partitions as on a cluster: the keys of both sides must hash alike."""
    rows = clusters(600)
    vectors = frame(spark, rows)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = {(r.id, r.other) for r in N.nearest(vectors, vectors, 10, 8, 1.0, shard=100).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert got == brute(rows, [i for i, _ in rows], 10)


def test_trees_with_factor_one_are_exact():
    rng = np.random.default_rng(0)
    points = rng.normal(size=(900, 6))
    points /= np.linalg.norm(points, axis=1)[:, None]
    tree = N.VantageTree(points, 16)
    d, _ = N.search_block(tree, points[:50], np.full(50, np.inf), 5, 1.0)
    assert np.allclose(d, np.sort(N._distances(points[:50], points), 1)[:, :5], atol=1e-6)
    exact, tree.looked = tree.looked, 0
    N.search_block(tree, points[:50], np.full(50, np.inf), 5, 2.0)
    assert tree.looked < exact < 50 * 900 + 50 * len(tree.nodes)


def test_an_id_with_many_points_hides_no_other():
    rng = np.random.default_rng(1)
    points = np.vstack([np.tile(np.eye(6)[0], (200, 1)) + 1e-3 * rng.normal(size=(200, 6)), rng.normal(size=(40, 6))])
    points /= np.linalg.norm(points, axis=1)[:, None]
    names = np.array(["hot"] * 200 + [f"o{j}" for j in range(40)], object)
    q, other, d = N.distinct_nearest(N.VantageTree(points, 8), names, np.array(["x"], object), points[:1], np.array([9.0]), 5, 1.0)
    true = sorted(N._distances(points[:1], points[200:])[0])[:4]
    assert other[0] == "hot" and len(set(other)) == 5 and np.allclose(d[1:], true)


def test_cells_are_packed_in_order():
    shard_of, blocks = N.packed(np.array([5, 4, 3, 30, 1, 0, 2]), 10)
    assert list(shard_of) == [0, 0, 1, 2, 3, 3, 3] and list(blocks) == [1, 1, 3, 1]


def test_unusable_rows_take_no_part(spark):
    good = np.eye(8)
    rows = [("a", good[0]), ("a", good[0]), ("b", good[0] + 0.1), ("n", None), (None, good[0]), ("z", [0] * 8), ("s", [1] * 7), ("nan", [float("nan")] + [1] * 7), ("inf", [float("inf")] + [1] * 7), ("e", [None] + [1] * 7)]
    assert sorted(r.id for r in frame(spark, rows).collect()) == ["a", "a", "b"]
    vectors = frame(spark, rows)
    assert {(r.id, r.other, r.place) for r in N.nearest(vectors, vectors, 10, 8).collect()} == {("a", "b", 1), ("b", "a", 1)}


def test_copies_ties_and_several_vectors_of_one_id(spark):
    one, two = np.eye(8)[0], np.eye(8)[1]
    rows = [(f"k{j}", one) for j in range(30)] + [("k0", two), ("w", two)]
    vectors = frame(spark, rows)
    got = {}
    for r in N.nearest(vectors, vectors, 3, 8, 1.0, shard=8).collect():
        got.setdefault(r.id, []).append((r.place, r.other))
    assert [o for _, o in sorted(got["k5"])] == ["k0", "k1", "k10"]
    assert sorted(got["w"])[0][1] == "k0" and len(got) == 31 and all(len(x) == 3 for x in got.values())


def test_empty_tables(spark):
    vectors, none = frame(spark, clusters(20)), frame(spark, [])
    assert N.nearest(none, vectors, 3, 8).count() == N.nearest(none, none, 3, 8).count() == N.nearest(vectors, none, 3, 8).count() == 0
