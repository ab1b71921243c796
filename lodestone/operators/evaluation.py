"""Quality of rankings against relevant documents, per query and averaged."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def scores(ranking: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """``query_id, recall, rr, ndcg`` for every query with a relevant document.

    ``ranking``: query_id, doc, rank; ``relevant``: query_id, doc. A document counts once, at its
    first rank, for recall and nDCG; the reciprocal rank looks at the whole list as it stands.
    ``k`` of 0 or less gives 0; a query without results scores 0.
    """
    wanted = relevant.select("query_id", "doc").distinct()
    total = wanted.groupBy("query_id").agg(F.count(F.lit(1)).alias("total"))
    once = ranking.groupBy("query_id", "doc").agg(F.min("rank").alias("rank"))
    placed = once.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "doc")))
    hits = placed.join(wanted, ["query_id", "doc"]).groupBy("query_id").agg(
        F.count_if(F.col("place") <= k).alias("hits"), F.sum(F.when(F.col("place") <= k, 1 / F.log2(F.col("place") + 1))).alias("dcg"), F.min("rank").alias("first")
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(F.col("total"), F.lit(k)), F.lit(1)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    out = total.join(hits, "query_id", "left")
    some = F.lit(k > 0)
    return out.select(
        "query_id", F.when(some, F.coalesce("hits", F.lit(0)) / F.col("total")).otherwise(0.0).alias("recall"),
        F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("rr"), F.when(some, F.coalesce("dcg", F.lit(0.0)) / ideal).otherwise(0.0).alias("ndcg"),
    )


def report(scored: DataFrame, bucket: str = "bucket") -> DataFrame:
    """Means per bucket and over all queries (bucket ``overall``)."""
    out = scored.rollup(bucket).agg(F.count(F.lit(1)).alias("queries"), *[F.round(F.avg(c), 6).alias(c) for c in ("recall", "rr", "ndcg")], F.grouping_id().alias("level"))
    return out.withColumn(bucket, F.when(F.col("level") == 1, "overall").otherwise(F.col(bucket))).drop("level")


def regressions(current: DataFrame, baseline: DataFrame, slack: float = 1e-9) -> DataFrame:
    """``metric, was, now`` of every baseline metric that is missing, not a number, or worse by more than ``slack``."""
    both = baseline.select("metric", F.col("value").alias("was")).join(current.select("metric", F.col("value").alias("now")), "metric", "left")
    return both.filter(F.col("now").isNull() | F.isnan("now") | (F.col("now") < F.col("was") - slack))
