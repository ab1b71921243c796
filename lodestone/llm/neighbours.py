"""The k most similar vectors of every query vector, by vantage-point trees per shard.

Vectors are scaled to length one, so that the Euclidean distance orders as cosine does and the
triangle inequality holds. A bounded sample gives the pivots of small cells, found in two levels;
neighbouring cells are packed into shards of about ``SHARD`` vectors, and a cell with more is cut
into blocks by hash, so a hot cluster is spread over tasks. Every block holds one vantage-point
tree; cells only tell where to go.

A query first searches its own shard, which bounds its k-th distance ``tau``. It is then sent
only to the shards with a cell that can hold something nearer: a cell whose lower bound by the
triangle inequality, times ``relax``, reaches ``tau`` is skipped. The same test prunes the
branches of each tree. ``relax=1`` is exact; a larger factor prunes more at some loss (the
tests measure recall against brute force).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.sources.tables import checkpoint

SHARD, CELL, LEAF = 8192, 128, 64
#: The pivots that are broadcast (at 64 dimensions 32 MB); shards grow in number with the vectors up to as many.
MOST_CELLS = 65_536
#: Queries that meet a block in one task, and that go down a tree together.
ASKED, AT_ONCE = 16_384, 2048
RELAX = 1.3
_FAR = 9.0


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2.0 - 2.0 * (a @ b.T), 0.0))


class Best:
    """The k nearest so far of each query, and the distance beyond which nothing matters."""

    def __init__(self, n: int, k: int, limit: np.ndarray):
        self.k, self.d, self.rows, self.limit = k, np.full((n, k), np.inf), np.full((n, k), -1), limit.astype(float)

    def add(self, active: np.ndarray, names: np.ndarray, near: np.ndarray) -> None:
        some = (near <= self.limit[active, None]).any(1)
        if not some.any():
            return
        active, near = active[some], near[some]
        both = np.concatenate([self.d[active], near], 1)
        rows = np.concatenate([self.rows[active], np.broadcast_to(names, near.shape)], 1)
        pick = np.lexsort((rows, both), axis=1)[:, : self.k]
        self.d[active] = np.take_along_axis(both, pick, 1)
        self.rows[active] = np.take_along_axis(rows, pick, 1)
        self.limit[active] = np.minimum(self.limit[active], self.d[active, self.k - 1])


class VantageTree:
    """A vantage-point tree over the rows of ``points`` (unit vectors); ``looked`` counts the distances that its searches take.

    A node splits where the distances to its vantage point leave their widest gap, and keeps both
    edges of the gap; in clustered vectors a split at the median would cut through a cluster and prune nothing.
    """

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.points, self.nodes, self.leaf, self.looked = points, [], leaf, 0
        self._build(np.arange(len(points)))

    def _build(self, rows: np.ndarray) -> int:
        at = len(self.nodes)
        if len(rows) <= self.leaf:
            self.nodes.append((None, rows, 0.0, 0.0, 0, 0))
            return at
        self.nodes.append(None)
        centre = self.points[rows[at % len(rows)]]
        away = _distances(centre[None], self.points[rows])[0]
        order = np.argsort(away, kind="stable")
        near = away[order]
        low = min(self.leaf // 2, len(rows) // 4) + 1
        cut = low + int(np.argmax(near[low : len(near) - low + 1] - near[low - 1 : len(near) - low])) if near[low - 1] < near[-low] else 0
        if not cut:  # so many equal distances that a radius splits nothing: one leaf
            self.nodes[at] = (None, rows, 0.0, 0.0, 0, 0)
            return at
        first = self._build(rows[order[:cut]])
        second = self._build(rows[order[cut:]])
        self.nodes[at] = (centre, None, float(near[cut - 1]), float(near[cut]), first, second)
        return at

    def search(self, queries: np.ndarray, relax: float, best: Best) -> None:
        """Add the points nearer than the queries' limits to ``best``: first the leaf where a query belongs, then what its limit leaves open."""
        home = np.full(len(queries), -1)

        def look(leaf: int, part: np.ndarray) -> None:
            own = self.nodes[leaf][1]
            self.looked += len(own) * len(part)
            if len(own):
                best.add(part, own, _distances(queries[part], self.points[own]))

        def descend(node: int, part: np.ndarray) -> None:
            centre, _, inside, outside, first, second = self.nodes[node]
            if centre is None:
                home[part] = node
                look(node, part)
                return
            self.looked += len(part)
            inner = _distances(queries[part], centre[None])[:, 0] <= (inside + outside) / 2
            for child, some in ((first, part[inner]), (second, part[~inner])):
                if len(some):
                    descend(child, some)

        def visit(node: int, part: np.ndarray) -> None:
            centre, _, inside, outside, first, second = self.nodes[node]
            if centre is None:
                part = part[home[part] != node]
                if len(part):
                    look(node, part)
                return
            self.looked += len(part)
            away = _distances(queries[part], centre[None])[:, 0]
            for child, bound in ((first, away - inside), (second, outside - away)):
                some = part[np.maximum(bound, 0) * relax < best.limit[part]]
                if len(some):
                    visit(child, some)

        everyone = np.arange(len(queries))
        descend(0, everyone)
        visit(0, everyone)


def search_block(tree: VantageTree, queries: np.ndarray, tau: np.ndarray, k: int, relax: float) -> tuple[np.ndarray, np.ndarray]:
    """Distances and rows of the k points of a block nearest to each query."""
    found = [Best(len(queries[i : i + AT_ONCE]), k, tau[i : i + AT_ONCE]) for i in range(0, len(queries), AT_ONCE)]
    for i, best in enumerate(found):
        tree.search(queries[i * AT_ONCE : (i + 1) * AT_ONCE], relax, best)
    return np.concatenate([b.d for b in found]), np.concatenate([b.rows for b in found])


def distinct_nearest(tree: VantageTree, names: np.ndarray, ids: np.ndarray, queries: np.ndarray, tau: np.ndarray, k: int, relax: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query row, other id and distance of the k other ids nearest to each query.

    ``names`` are the ids of the tree's points, of which several may be equal; a query whose k + 1
    nearest points bear too few ids asks again for four times as many.
    """
    asked, most, out = np.arange(len(queries)), k + 1, []
    while len(asked):
        d, rows = search_block(tree, queries[asked], tau[asked], most, relax)
        q, c = np.nonzero((rows >= 0) & (d <= tau[asked][:, None]))
        hits = pd.DataFrame({"q": asked[q], "other": names[rows[q, c]], "d": d[q, c]})
        hits = hits[ids[hits["q"].to_numpy()] != hits["other"].to_numpy()].sort_values(["q", "d", "other"], kind="stable").drop_duplicates(["q", "other"])
        some = hits.groupby("q").size().reindex(asked, fill_value=0).to_numpy()
        again = (some < k) & (d[:, -1] <= tau[asked]) & (most < len(names))
        out.append(hits[~hits["q"].isin(asked[again])].groupby("q").head(k))
        asked, most = asked[again], min(4 * most, len(names))
    hits = pd.concat(out) if out else pd.DataFrame({"q": np.array([], int), "other": np.array([], object), "d": np.array([], float)})
    return hits["q"].to_numpy(), hits["other"].to_numpy(), hits["d"].to_numpy()


def usable(vectors: DataFrame, dim: int, id_col: str = "chunk_id", vector_col: str = "vector") -> DataFrame:
    """``id, vector`` of the rows that can take part; repeated rows stay.

    Left out: null ids and vectors, other lengths than ``dim``, null or not finite elements,
    and vectors that are all zero.
    """
    v = F.col(vector_col)
    fit = F.col(id_col).isNotNull() & (F.size(v) == dim)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vectors.filter(fit).filter(finite & F.exists(v, lambda x: x != 0)).select(F.col(id_col).alias("id"), v.cast("array<float>").alias("vector"))


def _matrix(column: pd.Series, dim: int) -> np.ndarray:
    """The vectors as rows of doubles at length one."""
    if not len(column):
        return np.empty((0, dim))
    rows = np.vstack(column.to_numpy()).astype(float)
    return rows / np.linalg.norm(rows, axis=1)[:, None]


class Cells:
    """The pivots of all cells in two levels: a vector goes to the nearest of the first, and there to the nearest of its group."""

    def __init__(self, pivots: np.ndarray):
        self.tops = pivots[: max(1, int(np.sqrt(len(pivots))))]
        top = np.concatenate([_distances(pivots[i : i + 4096], self.tops).argmin(1) for i in range(0, len(pivots), 4096)])
        order = np.argsort(top, kind="stable")  # cells of one group lie side by side
        self.pivots, self.starts = pivots[order], np.searchsorted(top[order], np.arange(len(self.tops) + 1))

    def place(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cell of each point, and its distance to the cell's pivot."""
        cell, away = np.zeros(len(points), int), np.zeros(len(points))
        top = _distances(points, self.tops).argmin(1)
        for t in np.unique(top):
            own, a, b = np.flatnonzero(top == t), self.starts[t], self.starts[t + 1]
            near = _distances(points[own], self.pivots[a:b])
            cell[own] = a + near.argmin(1)
            away[own] = near.min(1)
        return cell, away


def packed(sizes: np.ndarray, shard: int) -> tuple[np.ndarray, np.ndarray]:
    """The shard of each cell, neighbours together up to ``shard`` vectors, and the blocks that each shard is cut into."""
    shard_of, load, now = np.zeros(len(sizes), int), 0, 0
    for c, n in enumerate(sizes):
        if load and load + n > shard:
            now, load = now + 1, 0
        shard_of[c] = now
        load += n
    return shard_of, np.maximum(1, -(-np.bincount(shard_of, sizes, now + 1).astype(int) // shard))


def nearest(queries: DataFrame, vectors: DataFrame, k: int = 10, dim: int = 64, relax: float = RELAX, shard: int = SHARD) -> DataFrame:
    """``id, other, similarity, place`` -- for each query the k other ids of largest cosine.

    ``queries`` and ``vectors`` are frames of :func:`usable`; repeated rows count once. An id is never its own neighbour;
    an id with several vectors counts by its best one. Ties are broken by id. A query gets fewer
    than k rows only if there are fewer other ids. Empty frames give an empty result.
    """
    spark = queries.sparkSession
    context, schema = spark.sparkContext, "id string, other string, d double"
    n = vectors.count()
    wished = max(1, min(MOST_CELLS, n // CELL))
    every = max(1, n // (4 * wished))
    sample = vectors.filter(F.pmod(F.xxhash64("id"), F.lit(every)) == 0).distinct().orderBy(F.xxhash64("id"), "id").limit(wished)
    pivots = np.unique(_matrix(sample.select("vector").toPandas()["vector"], dim), axis=0) if n else np.zeros((0, dim))
    if not len(pivots):
        pivots = np.zeros((1, dim))
    cells = Cells(pivots[np.random.default_rng(0).permutation(len(pivots))])
    shared = context.broadcast(cells)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cell, away = shared.value.place(_matrix(batch["vector"], dim))
            yield batch.assign(cell=cell.astype("int32"), away=away)

    placed_schema = "id string, vector array<float>, cell int, away double"
    placed = checkpoint(vectors.dropDuplicates(["id", "vector"]).mapInPandas(place, placed_schema))  # read three times
    wanted = checkpoint(queries.dropDuplicates(["id", "vector"]).mapInPandas(place, placed_schema).select("id", "vector", "cell"))
    sizes = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("reach")).toPandas()  # at most MOST_CELLS rows
    count, reach = np.zeros(len(cells.pivots), int), np.full(len(cells.pivots), -_FAR)
    count[sizes["cell"]], reach[sizes["cell"]] = sizes["n"], sizes["reach"]
    shard_of, blocks = packed(count, shard)
    starts = np.searchsorted(shard_of, np.arange(len(blocks)))
    routes = context.broadcast((shard_of, starts, reach))
    per_cell = lambda: F.broadcast(spark.createDataFrame(pd.DataFrame({"cell": np.arange(len(shard_of)), "shard": shard_of}), "cell int, shard int"))
    keys = ["shard", "block", "ask"]
    located = placed.join(per_cell(), "cell").select("id", "vector", "shard")

    def searched(asked: DataFrame) -> DataFrame:
        """``id, other, d``: the k nearest of each row of ``asked`` (id, vector, tau, shard) in each block of its shard."""
        waiting = asked.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).toPandas()  # at most as many rows as shards
        asks = np.zeros(len(blocks), int)
        asks[waiting["shard"]] = -(-waiting["n"].to_numpy(int) // ASKED)
        parts = lambda: F.broadcast(spark.createDataFrame(pd.DataFrame({"shard": np.arange(len(blocks)), "blocks": blocks, "asks": asks}), "shard int, blocks int, asks int"))
        cut = lambda many, *by: F.pmod(F.xxhash64(*by), F.col(many)).cast("int")
        each = lambda many: F.explode(F.sequence(F.lit(0), F.col(many) - 1))
        points = located.join(parts().filter("asks > 0"), "shard").select("id", "vector", "shard", cut("blocks", "id", "vector").alias("block"), each("asks").alias("ask"))
        queried = asked.join(parts(), "shard").select("id", "vector", "tau", "shard", cut("asks", "id").alias("ask"), each("blocks").alias("block"))

        def search(_, points: pd.DataFrame, queried: pd.DataFrame) -> pd.DataFrame:
            if not len(points) or not len(queried):
                return pd.DataFrame({"id": np.array([], object), "other": np.array([], object), "d": np.array([], float)})
            points = points.sort_values("id")
            ids = queried["id"].to_numpy()
            tree = VantageTree(_matrix(points["vector"], dim))
            q, other, d = distinct_nearest(tree, points["id"].to_numpy(), ids, _matrix(queried["vector"], dim), queried["tau"].to_numpy(), k, relax)
            return pd.DataFrame({"id": ids[q], "other": other, "d": d})

        return points.groupBy(*keys).cogroup(queried.groupBy(*keys)).applyInPandas(search, schema)

    def best(found: DataFrame) -> DataFrame:
        """The k nearest of all candidates; both steps combine before they shuffle."""
        once = found.groupBy("id", "other").agg(F.min("d").alias("d"))
        place = F.row_number().over(Window.partitionBy("id").orderBy("d", "other"))
        return once.withColumn("place", place).filter(F.col("place") <= k)

    home = wanted.join(per_cell(), "cell").select("id", "vector", F.lit(_FAR).alias("tau"), "shard")
    at_home = checkpoint(best(searched(home)))
    bound = at_home.filter(F.col("place") == k).select("id", F.col("d").alias("tau"))
    known = wanted.join(bound, "id", "left").select("id", "vector", "cell", F.coalesce("tau", F.lit(_FAR)).alias("tau"))

    def elsewhere(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard_of, starts, reach = routes.value
        step = max(1, (1 << 23) // len(reach))
        for whole in batches:
            for i in range(0, len(whole), step):
                batch = whole.iloc[i : i + step]
                least = np.maximum(_distances(_matrix(batch["vector"], dim), shared.value.pivots) - reach, 0)
                go = np.logical_or.reduceat((least * relax < batch["tau"].to_numpy()[:, None]) & (reach >= 0), starts, axis=1)
                go[np.arange(len(batch)), shard_of[batch["cell"].to_numpy()]] = False
                q, s = np.nonzero(go)
                yield batch.iloc[q][["id", "vector", "tau"]].assign(shard=s.astype("int32"))

    sent = checkpoint(known.mapInPandas(elsewhere, "id string, vector array<float>, tau double, shard int"))
    result = best(at_home.drop("place").unionByName(searched(sent)))
    return result.select("id", "other", (1 - F.col("d") * F.col("d") / 2).alias("similarity"), "place")
