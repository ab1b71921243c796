"""Exact vector search of a query set, in blocks, and what is derived from its scores."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.best import Best

#: Candidates scored at once, queries multiplied at once, vectors that give a first floor, and more than products of short floats are off.
BLOCK, AT_ONCE, FIRST, SHORT = 8192, 256, 2048, 1e-4
#: The largest part of a query set that is broadcast.
MOST_BYTES = 32 << 20


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalized(vector: Column) -> Column:
    """The vector of doubles at length one; an all-zero vector stays as it is."""
    length = norm(vector)
    return F.when(length == 0, F.transform(vector, lambda x: x.cast("double"))).otherwise(F.zip_with(vector, F.array_repeat(length, F.size(vector)), lambda x, n: x.cast("double") / n))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 if either is all zero, an error if their lengths differ."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    size = norm(a) * norm(b)
    return F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors of different length"))).when(size == 0, 0.0).otherwise(dot / size)


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1), 1e-300)[:, None]


def _matrix(vectors: pa.Array, dim: int) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)


def _multiplied(best: Best, ids: np.ndarray, points: np.ndarray, asked: np.ndarray) -> None:
    """Add a block of unit vectors to what each query has: short products choose the candidates, whole ones score them."""
    limit, short, wide = best.ids.shape[1], points.astype(np.float32).T, asked.astype(np.float32)
    for i in range(0, len(asked), AT_ONCE):
        score, floor = wide[i : i + AT_ONCE] @ short, best.floor[i : i + AT_ONCE].copy()
        some = score[:, : max(limit, FIRST)]
        if np.isneginf(floor).any() and some.shape[1] >= limit:  # these many are as good, so the best are
            floor = np.maximum(floor, np.partition(some, -limit, axis=1)[:, -limit] - SHORT)
        query, row = np.nonzero(score >= (floor - SHORT)[:, None])
        for k in range(0, len(query), BLOCK):
            q, r = query[k : k + BLOCK] + i, row[k : k + BLOCK]
            best.add(q, ids[r], np.einsum("ij,ij->i", asked[q], points[r]))


def _search_slice(left: DataFrame, right: DataFrame, limit: int, dim: int, schema: str) -> DataFrame:
    spark = left.sparkSession
    asked = right.toArrow()
    points, number = np.unique(_unit(_matrix(asked.column("v").combine_chunks(), dim)), axis=0, return_inverse=True)  # equal vectors are compared once
    stands = pa.table({"asked": pa.array(number.ravel(), pa.int32()), "query_id": asked.column("query_id")})
    same = spark.createDataFrame(stands, f"asked int, query_id {dict(right.dtypes)['query_id']}")
    shared, given = spark.sparkContext.broadcast(points), pa.schema([("asked", pa.int32()), ("id", left.limit(0).toArrow().schema.field("id").type), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(shared.value), limit)
        for batch in batches:
            if batch.num_rows and len(shared.value):
                _multiplied(best, batch.column("id").to_numpy(zero_copy_only=False), _unit(_matrix(batch.column("v"), dim)), shared.value)
        yield from best.batches(given)

    near = left.mapInArrow(run, schema)
    order = Window.partitionBy("asked").orderBy(F.desc(F.round("score", 9)), "id")
    top = near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)
    return top.join(F.broadcast(same), "asked").select("query_id", "id", "score", "rank")  # a slice of the queries


def search(vectors: DataFrame, queries: DataFrame, limit: int = 10, dim: int = 64, unique: bool = False) -> DataFrame:
    """``query_id, id, score, rank`` of the ``limit`` vectors of largest cosine for each query.

    ``vectors``: id, vector; ``queries``: query_id, vector. Every query is compared with every
    vector. Queries are sent to the vectors, which stay where they are, in slices of about
    ``MOST_BYTES``, each of which reads the vectors again; of each task the ``limit`` best of each
    query are shuffled. Null vectors and those of another length are left out; zero vectors score 0.
    Ties go to the smaller id, an integer. ``unique``: no id of ``vectors`` repeats.
    """
    fit = lambda name: F.col(name).isNotNull() & (F.size(name) == dim)
    left, right = vectors.filter(fit("vector")), queries.filter(fit("vector")).dropDuplicates(["query_id"])
    left, right = (left if unique else left.dropDuplicates(["id"])).select("id", F.col("vector").alias("v")), right.select("query_id", F.col("vector").alias("v"))
    slices = max(1, -(-right.count() // max(1, MOST_BYTES // ((dim + 4) * 8))))
    each = [right.filter(F.pmod(F.xxhash64("v"), F.lit(slices)) == k) if slices > 1 else right for k in range(slices)]
    return reduce(DataFrame.unionByName, [_search_slice(left, part, limit, dim, f"asked int, id {dict(vectors.dtypes)['id']}, score double") for part in each])


def top_cosine(ranked: DataFrame, n: int = 3) -> DataFrame:
    """``query_id, top_cosine``: the largest non-null cosine among the first ``n`` results, at least 0."""
    first = F.max(F.when(F.col("rank") <= n, F.col("cosine")))
    return ranked.groupBy("query_id").agg(F.greatest(F.coalesce(first, F.lit(0.0)), F.lit(0.0)).alias("top_cosine"))
