"""The query ledger: entries and later outcomes as one row per query, and views of it.

Lines are ordered by arrival, then by table and line number. Everything per query is an
aggregate that combines before the shuffle, so that an identifier used by many lines is no
hot group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FIELDS = ["consumer", "query_text", "result_count", "band", "latency_ms"]


def _ordered(lines: DataFrame, kind: int) -> DataFrame:
    return lines.filter("query_id is not null").withColumn("at", F.struct(F.col("arrived_at").alias("arrived_at"), F.lit(kind).alias("kind"), F.col("line_no").alias("line_no")))


def reconciled(entries: DataFrame, outcomes: DataFrame) -> DataFrame:
    """One row per query id with an entry: the last entry, with the fields of outcomes that came after it.

    A later outcome overwrites an earlier one, its null fields keep what was there. Outcomes without
    an entry before them are dropped; those before a repeated entry are lost with the entry they
    belonged to. ``first_line`` is the line number of the first entry. Null query ids are no lines.
    """
    kept = [*FIELDS, "answered", "tokens", "est_cost"]
    last = _ordered(entries, 0).groupBy("query_id").agg(F.max(F.struct("at", *kept)).alias("e"), F.min("at").alias("first"))
    after = _ordered(outcomes, 1).select("query_id", "at", "answered", "tokens", "est_cost").join(last.select("query_id", F.col("e.at").alias("since")), "query_id").filter("at > since")
    newest = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct("at", F.col(c).alias("v"))))["v"].alias(f"late_{c}")
    late = after.groupBy("query_id").agg(*[newest(c) for c in ("answered", "tokens", "est_cost")])
    both = last.join(late, "query_id", "left")
    return both.select(
        "query_id", *[F.col(f"e.{c}").alias(c) for c in FIELDS],
        *[F.coalesce(f"late_{c}", f"e.{c}").alias(c) for c in ("answered", "tokens", "est_cost")],
        F.col("first.line_no").alias("first_line"),
    )


def newest(ledger: DataFrame, limit: int, consumer: str | None = None) -> DataFrame:
    """The ``limit`` newest reconciled rows, of one consumer if given, newest first."""
    rows = ledger if consumer is None else ledger.filter(F.col("consumer") == consumer)
    return rows.orderBy(F.desc("first_line")).limit(limit)


def latest(ledger: DataFrame) -> DataFrame:
    """``layer, query_id``: the newest entry, and the newest that was answered (null if none)."""
    by = lambda c: F.max_by("query_id", F.when(c, F.col("first_line")))
    one = ledger.agg(by(F.lit(True)).alias("retrieve"), by(F.col("answered")).alias("answer"))
    return one.select(F.explode(F.create_map(F.lit("retrieve"), F.col("retrieve"), F.lit("answer"), F.col("answer"))).alias("layer", "query_id"))


def replay(lines: DataFrame, by: str, keep: int = 50, order: str = "line_no") -> DataFrame:
    """The last ``keep`` lines of each ``by``, with ``age`` 1 for the newest."""
    return lines.withColumn("age", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(order)))).filter(F.col("age") <= keep)


def first_events(events: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first event of each key: what a replay followed by a tail shows once."""
    rest = [c for c in events.columns if c not in keys]
    first = events.groupBy(*keys).agg(F.min(F.struct(*order, *[c for c in rest if c not in order])).alias("e"))
    return first.select(*keys, *[F.col(f"e.{c}").alias(c) for c in rest])


def totals(ledger: DataFrame) -> DataFrame:
    """``consumer, band`` with subtotals (null: all): queries, answered, refused share, tokens, mean latency."""
    return ledger.rollup("consumer", "band").agg(
        F.count(F.lit(1)).alias("queries"), F.count_if(F.col("answered")).alias("answered"), F.sum("tokens").alias("tokens"),
        F.round(F.avg("latency_ms"), 3).alias("mean_latency"), F.grouping_id().cast("int").alias("level"),
    )
