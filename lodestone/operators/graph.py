"""The call and import graph of chunks, and its use in search.

Edges are kept in a compact form. A call that names many definers, or an import of a file with
many chunks, is one link to a key (``exact`` or ``short`` name, ``file``); the key's members are
listed once. Only where a caller's imports single out definers is the link a pair. All pairs of
a popular name are never written out; they arise only for the seeds of a query.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text
from lodestone.operators.references import file_key, resolve_path
from lodestone.sources.tables import broadcast_if_small, checkpoint, once

_KEY = ["repo", "kind", "name"]
#: Ends of seeds that are sent to the tasks at once, and pairs of chunk and seed that a task counts at once.
MOST, BLOCK = 1_000_000, 1_000_000


def nodes(chunks: DataFrame) -> DataFrame:
    """``seq, repo, path_key, symbol, calls, imports`` of every chunk once; ``imports`` are resolved paths."""
    rows = once(chunks.select("seq", "repo", "path", "symbol", "structural_refs"), "seq")
    empty = F.array().cast("array<string>")
    some = lambda c: F.array_distinct(F.filter(F.coalesce(c, empty), lambda x: x.isNotNull()))
    relative = F.filter(some(F.col("structural_refs.imports")), lambda x: x.startswith("."))
    return rows.select(
        "seq", "repo", file_key(F.col("path")).alias("path_key"), "symbol", some(F.col("structural_refs.calls")).alias("calls"),
        F.array_distinct(F.transform(relative, lambda x: resolve_path(F.col("path"), x))).alias("imports"),
    )


def members(graph: DataFrame) -> DataFrame:
    """``repo, kind, name, dst, path_key``: who bears a whole name, a short name, or lies in a file."""
    whole = graph.select("repo", F.lit("exact").alias("kind"), F.col("symbol").alias("name"), F.col("seq").alias("dst"), "path_key")
    short = graph.filter(F.col("symbol").contains(".")).select("repo", F.lit("short").alias("kind"), text.short_name(F.col("symbol")).alias("name"), F.col("seq").alias("dst"), "path_key")
    file = graph.select("repo", F.lit("file").alias("kind"), F.col("path_key").alias("name"), F.col("seq").alias("dst"), "path_key")
    return whole.unionByName(short).unionByName(file).filter("name is not null")


def links(graph: DataFrame) -> DataFrame:
    """``src, repo, kind, name, dst`` -- one row per resolved call or import; ``dst`` only for kind ``pair``.

    A call goes to the definers of its whole name or, if there are none, to those of the short
    name. If several define it and the caller imports the file of some, only those count. Names
    without a definer and imports of unknown files give no link.
    """
    known = members(graph)
    calls = graph.select(F.col("seq").alias("src"), "repo", "imports", F.explode("calls").alias("name"))
    keys = known.filter("kind <> 'file'").groupBy("repo", "name").agg(F.min("kind").alias("kind"))  # exact before short
    resolved = calls.join(keys, ["repo", "name"]).select("src", "repo", "kind", "name", "imports")
    chosen = resolved.select("src", *_KEY, F.explode("imports").alias("path_key")).join(known, [*_KEY, "path_key"]).select("src", *_KEY, "dst").distinct()
    open_calls = resolved.select("src", *_KEY).join(chosen.select("src", *_KEY).distinct(), ["src", *_KEY], "left_anti")
    files = known.filter("kind = 'file'").select("repo", "name").distinct()
    imports = graph.select(F.col("seq").alias("src"), "repo", F.explode("imports").alias("name")).join(files, ["repo", "name"])
    none = F.lit(None).cast("bigint").alias("dst")
    return (
        chosen.select("src", "repo", F.lit("pair").alias("kind"), "name", "dst")
        .unionByName(open_calls.select("src", *_KEY, none))
        .unionByName(imports.select("src", "repo", F.lit("file").alias("kind"), "name", none))
    )


def seeds(ranked: DataFrame, queries: DataFrame, graph: DataFrame, count: int = 10) -> DataFrame:
    """``query_id, seed``: the first ``count`` direct hits and whatever bears a word of the query as its whole name."""
    direct = ranked.filter(F.col("rank") <= count).select("query_id", F.col("doc").alias("seed"))
    tokens = queries.select("query_id", F.explode(F.array_distinct(F.regexp_extract_all("query_text", F.lit(r"([A-Za-z0-9_]+)"), 1))).alias("symbol"))
    named = graph.select("symbol", F.col("seq").alias("seed")).join(broadcast_if_small(tokens), "symbol").select("query_id", "seed")
    return direct.unionByName(named).distinct()


def _ends(linked: DataFrame, known: DataFrame) -> DataFrame:
    """``node, end``: two nodes are neighbours if one has an even end and the other the odd end that follows it.

    A link to a key makes an odd end, a membership an even one; a caller and the definers it singles out
    share a key of their own. Keys that only one side has are left out.
    """
    pair = linked.filter("kind = 'pair'").select(
        F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("odd")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("odd")))).alias("e"),
        F.lit("").alias("repo"), F.lit("pair").alias("kind"), F.col("src").cast("string").alias("name"),
    )
    links_to = linked.filter("kind <> 'pair'").select(F.col("src").alias("node"), F.lit(1).alias("odd"), *_KEY)
    each = known.select(F.col("dst").alias("node"), F.lit(0).alias("odd"), *_KEY).unionByName(links_to).unionByName(pair.select("e.node", "e.odd", *_KEY))
    both = each.groupBy(*_KEY).agg(F.min("odd").alias("least"), F.max("odd").alias("most")).filter("least < most")
    keys = checkpoint(both.select(*_KEY, F.monotonically_increasing_id().alias("key")))  # numbered once
    return checkpoint(each.join(keys, _KEY).select("node", (F.col("key") * 2 + F.col("odd")).alias("end")))


class _Asked:
    """The seeds of a slice of the queries, to be met by batches of chunks; queries of the same seeds are answered once."""

    def __init__(self, touching: pa.Table):
        queries = touching.column("query_id").combine_chunks().dictionary_encode()
        query, end = queries.indices.to_numpy(zero_copy_only=False).astype(np.int64), touching.column("end").to_numpy()
        self.seeds, seed = np.unique(touching.column("seed").to_numpy(), return_inverse=True)
        own = np.unique(query * max(len(self.seeds), 1) + seed)
        query_of, seed_of = np.divmod(own, max(len(self.seeds), 1))
        alike: dict[bytes, int] = {}
        lists = np.split(seed_of, np.flatnonzero(np.diff(query_of)) + 1) if len(own) else []
        stands = [alike.setdefault(x.tobytes(), len(alike)) for x in lists]
        self.same = pa.table({"asked": pa.array(stands, pa.int32()), "query_id": queries.dictionary})
        self.count = len(alike)
        lists = [np.frombuffer(x, np.int64) for x in alike]
        asked, held = np.repeat(np.arange(len(lists), dtype=np.int32), [len(x) for x in lists]), np.concatenate([*lists, np.zeros(0, np.int64)])
        order = np.argsort(held, kind="stable")
        self.asked, self.asked_at = asked[order], np.searchsorted(held[order], np.arange(len(self.seeds) + 1))
        self.ends, number = np.unique(end, return_inverse=True)
        pairs = np.unique(number * max(len(self.seeds), 1) + seed)
        self.seed_at = np.searchsorted(pairs, np.arange(len(self.ends) + 1) * max(len(self.seeds), 1))
        self.seed = (pairs % max(len(self.seeds), 1)).astype(np.int32)
        asks = np.concatenate([[0], np.cumsum(np.diff(self.asked_at)[self.seed])])
        self.weight = asks[self.seed_at[1:]] - asks[self.seed_at[:-1]]  # of an end, the pairs of query and seed that it touches

    def _spread(self, row: np.ndarray, at: np.ndarray, number: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each row once for each of the values that its number has."""
        size = at[number + 1] - at[number]
        place = np.arange(size.sum()) + np.repeat(at[number] - np.cumsum(size) + size, size)
        return np.repeat(row, size), values[place]

    def _counted(self, doc: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        docs, row = np.unique(doc, return_inverse=True)
        row, seed = self._spread(row, self.seed_at, end, self.seed)
        pairs = np.sort(row * len(self.seeds) + seed)
        row, seed = np.divmod(pairs[np.diff(pairs, prepend=-1) > 0], len(self.seeds))  # a seed counts once, by whatever ends
        row, asked = self._spread(row, self.asked_at, seed, self.asked)
        pairs = np.sort(row * self.count + asked)
        first = np.flatnonzero(np.diff(pairs, prepend=-1) > 0)
        pairs, score = pairs[first], np.diff(first, append=len(pairs))
        place = np.searchsorted(self.seeds, docs)
        own = np.flatnonzero(self.seeds[np.minimum(place, len(self.seeds) - 1)] == docs)
        row, asked = self._spread(own, self.asked_at, place[own], self.asked)
        kept = np.isin(pairs, row * self.count + asked, invert=True)
        row, asked = np.divmod(pairs[kept], self.count)
        return asked.astype(np.int32), docs[row], score[kept].astype(np.int32)

    def neighbours(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Asked, chunk and score, of chunks' ends in order of the chunks; in blocks, no chunk in two of them."""
        held, size = [], 0

        def blocks(last: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            nonlocal held, size
            doc, end = map(np.concatenate, zip(*held))
            bound, total = np.append(np.flatnonzero(np.diff(doc)) + 1, len(doc)), np.cumsum(self.weight[end])
            done = 0
            while done < (len(doc) if last else bound[-2] if len(bound) > 1 else 0):
                most = (total[done - 1] if done else 0) + BLOCK
                k = max(np.searchsorted(total[bound - 1], most, "right") - 1, np.searchsorted(bound, done, "right"))
                if not last:
                    k = min(k, len(bound) - 2)  # the last chunk may go on
                yield self._counted(doc[done : bound[k]], end[done : bound[k]])
                done = bound[k]
            held, size = [(doc[done:], end[done:])], self.weight[end[done:]].sum()

        for batch in batches if len(self.ends) else ():
            doc, end = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "end"))
            place = np.searchsorted(self.ends, end)
            some = self.ends[np.minimum(place, len(self.ends) - 1)] == end
            held.append((doc[some], place[some]))
            size += self.weight[place[some]].sum()
            if size >= BLOCK:
                yield from blocks(last=False)
        if held:
            yield from blocks(last=True)


@dataclass(frozen=True)
class Reach:
    """What the seeds of queries touch: ``ends`` of all nodes, and those of the seeds (query_id, seed, end) in slices by query."""

    ends: DataFrame
    touching: list[DataFrame]

    def _near(self, part: DataFrame, make, schema: str) -> DataFrame:  # noqa: ANN001
        spark = part.sparkSession
        asked = _Asked(part.toArrow())
        shared = spark.sparkContext.broadcast(asked)
        docs = self.ends.select(F.col("node").alias("doc"), F.col("end").bitwiseXOR(F.lit(1).cast("bigint")).alias("end"))
        docs = docs.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc").sortWithinPartitions("doc")
        same = spark.createDataFrame(asked.same, f"asked int, query_id {dict(part.dtypes)['query_id']}")
        return make(docs, shared, schema).join(F.broadcast(same), "asked")  # a slice of the queries

    def expanded(self) -> DataFrame:
        """``query_id, doc, score``, counted where the chunks are; no pair of query and chunk is shuffled."""

        def make(docs: DataFrame, shared, schema: str) -> DataFrame:  # noqa: ANN001
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for block in shared.value.neighbours(batches):
                    yield from pa.table(dict(zip(("asked", "doc", "score"), block))).to_batches(max_chunksize=100_000)

            return docs.mapInArrow(run, schema)

        each = [self._near(part, make, "asked int, doc bigint, score int").select("query_id", "doc", F.col("score").cast("bigint").alias("score")) for part in self.touching]
        return reduce(DataFrame.unionByName, each)

    def top(self) -> DataFrame:
        """``query_id, top``: the largest score of each query that reaches anything."""

        def make(docs: DataFrame, shared, schema: str) -> DataFrame:  # noqa: ANN001
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                best = np.zeros(shared.value.count, np.int64)
                for asked, _, score in shared.value.neighbours(batches):
                    np.maximum.at(best, asked, score)
                some = np.flatnonzero(best)
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(best[some])], names=["asked", "top"])

            return docs.mapInArrow(run, schema).groupBy("asked").agg(F.max("top").alias("top"))

        return reduce(DataFrame.unionByName, [self._near(part, make, "asked int, top bigint").select("query_id", "top") for part in self.touching])


def reach(seeded: DataFrame, linked: DataFrame, known: DataFrame) -> Reach:
    """The neighbours of a query's seeds, seeds left out. The graph counts as undirected; unknown seeds reach nothing; there is no limit."""
    ends = _ends(linked, known)
    touching = checkpoint(seeded.select("query_id", F.col("seed").alias("node")).join(ends, "node").select("query_id", F.col("node").alias("seed"), "end"))
    slices = max(1, -(-touching.count() // MOST))
    return Reach(ends, [touching.filter(F.pmod(F.xxhash64("query_id"), F.lit(slices)) == k) if slices > 1 else touching for k in range(slices)])


def expand(seeded: DataFrame, linked: DataFrame, known: DataFrame) -> DataFrame:
    """``query_id, doc, score``: neighbours of a query's seeds by how many seeds they touch, seeds left out."""
    return reach(seeded, linked, known).expanded()


def definitions(queries: DataFrame, graph: DataFrame) -> DataFrame:
    """``query_id, doc, pin`` -- the chunks that a query names, in order of the naming words, then of the chunks.

    A word that is a whole name gives all its bearers. Any other code-shaped word without a slash
    gives the bearer of that short name, if there is exactly one.
    """
    tokens = queries.select("query_id", F.posexplode(text.query_symbols(F.col("query_text"))).alias("pos", "token"))
    whole = graph.select(F.col("symbol").alias("token"), F.col("seq").alias("doc"))
    exact = tokens.join(whole, "token").select("query_id", "pos", "doc")
    rest = tokens.join(whole.select("token").distinct(), "token", "left_anti").filter(text.is_code_shaped(F.col("token")) & ~F.col("token").contains("/"))
    only = graph.groupBy(text.short_name(F.col("symbol")).alias("short")).agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("doc")).filter("n = 1")
    unique = rest.withColumn("short", text.short_name(F.col("token"))).join(only, "short").select("query_id", "pos", "doc")
    first = exact.unionByName(unique).groupBy("query_id", "doc").agg(F.min("pos").alias("pos"))
    return first.select("query_id", "doc", F.row_number().over(Window.partitionBy("query_id").orderBy("pos", "doc")).alias("pin"))


def pinned(expanded: DataFrame, defined: DataFrame, top: DataFrame | None = None) -> DataFrame:
    """``query_id, doc, score``: the definitions before all neighbours, with scores above theirs.

    ``top``: query_id, top -- the largest score of each query, where it is known otherwise than from ``expanded``.
    """
    if top is None:
        top = expanded.groupBy("query_id").agg(F.max("score").alias("top"))
    size = defined.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    pins = defined.join(size, "query_id").join(top, "query_id", "left")
    head = pins.select("query_id", "doc", (F.coalesce("top", F.lit(0)) + F.col("n") - F.col("pin") + 1).cast("bigint").alias("score"))
    return head.unionByName(expanded.join(defined.select("query_id", "doc"), ["query_id", "doc"], "left_anti").select("query_id", "doc", "score"))
