"""Messages delivered more than once: one line per message out of an at-least-once log.

A message key is ``(stream, id, slot)``. ``id`` is the identifier without letter case and
surrounding white space, ``slot`` separates different messages that reuse an identifier
(for a log with a clock, the second; otherwise a constant). Identifiers of the form
``<producer>:q<number>`` are producer-sequence identifiers: the numbers seen so far are kept
as disjoint ranges per producer, a number outside every range is accepted once without any
look at the log, and the ranges are merged. What the ranges cannot decide -- malformed
identifiers, and numbers that are covered but may belong to another slot -- is looked up by
its exact key among the messages accepted so far.

A log is folded in append order: each epoch is accepted against the ranges and keys that the
epochs before it left, as a stream accepts each batch. The number space of a producer is cut
into blocks, so that a hot producer is spread over tasks; within an epoch copies are combined
before any shuffle, so that one message delivered a million times is one row per map task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.sources.tables import checkpoint

BLOCK, EPOCHS = 4096, 3
SEQUENCE_ID = r"^(.+):q(0|[1-9][0-9]{0,14})$"

_BLOCK = ["stream", "producer", "block"]
_KEY = ["stream", "message_id", "slot"]
RANGES = "stream string, producer string, block long, lo long, hi long"
LOG = "stream string, message_id string, slot long, line_no long"


@dataclass(frozen=True)
class Seen:
    """What was accepted so far.

    ``ranges``: stream, producer, block, lo, hi -- disjoint, one block each.
    ``log``: stream, message_id, slot, line_no -- the accepted lines by their exact keys.
    """

    ranges: DataFrame
    log: DataFrame


def nothing_seen(spark: SparkSession) -> Seen:
    return Seen(spark.createDataFrame([], RANGES), spark.createDataFrame([], LOG))


def normal_id(column: Column) -> Column:
    """The identifier without surrounding white space (Unicode) and letter case."""
    return F.lower(F.regexp_replace(column, r"(?U)^\s+|\s+$", ""))


def keyed_lines(lines: DataFrame, stream: str, id_col: str = "query_id", ts_col: str | None = None, line_col: str = "line_no") -> DataFrame:
    """``stream, line_no, message_id, slot, producer, number`` of the lines that can be copies.

    Lines with a null identifier, and with ``ts_col`` those with a null time, are never copies
    and are left out. Further columns of ``lines`` are ignored whatever their names.
    """
    slot = F.col(ts_col) - F.pmod(F.col(ts_col), F.lit(1000)) if ts_col else F.lit(0).cast("long")
    named = lines.select(
        F.lit(stream).alias("stream"),
        F.col(line_col).cast("long").alias("line_no"),
        normal_id(F.col(id_col)).alias("message_id"),
        slot.cast("long").alias("slot"),
    ).filter("message_id is not null and slot is not null and line_no is not null")
    producer = F.regexp_extract("message_id", SEQUENCE_ID, 1)
    return named.withColumn("producer", F.when(producer != "", producer)).withColumn(
        "number", F.when(producer != "", F.regexp_extract("message_id", SEQUENCE_ID, 2).cast("long"))
    )


def _sweep(fresh: DataFrame, ranges: DataFrame) -> DataFrame:
    """Numbers and seen ranges of each block in one pass from left to right.

    ``fresh``: stream, producer, block, number, slot, line_no. A number not reached by a range or
    an equal number before it is ``accepted``, any other ``covered``; rows that begin beyond the
    reach of all before them open a new range (``run`` numbers the merged ranges).
    """
    both = fresh.select(*_BLOCK, F.col("number").alias("lo"), F.col("number").alias("hi"), "slot", "line_no").unionByName(
        ranges.select(*_BLOCK, "lo", "hi", F.lit(None).cast("long").alias("slot"), F.lit(None).cast("long").alias("line_no"))
    )
    in_order = Window.partitionBy(*_BLOCK).orderBy("lo", F.col("line_no").asc_nulls_first())
    reach = F.max("hi").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    swept = both.withColumn("reach", reach).withColumn("opens", (F.col("reach").isNull() | (F.col("lo") > F.col("reach") + 1)).cast("int"))
    verdict = F.when(F.col("line_no").isNull(), "range").when(F.col("reach") >= F.col("lo"), "covered").otherwise("accepted")
    return swept.withColumn("verdict", verdict).withColumn("run", F.sum("opens").over(in_order))


def swept(lines: DataFrame, ranges: DataFrame, block: int = BLOCK) -> DataFrame:
    """The distinct messages of a batch of :func:`keyed_lines`, each with the verdict of the seen ranges.

    Verdicts: ``accepted`` (no range has the number), ``covered``, ``malformed`` (no number); the
    ranges that take part come out as well (verdict ``range``), with ``run`` numbering what merges.
    """
    first = lines.groupBy(*_KEY, "producer", "number").agg(F.min("line_no").alias("line_no"))
    numbered = first.filter("number is not null").withColumn("block", F.floor(F.col("number") / block).cast("long"))
    rows = _sweep(numbered, ranges).select(*_BLOCK, "lo", "hi", "slot", "line_no", "run", "verdict", F.when(F.col("line_no").isNotNull(), F.concat_ws(":q", "producer", F.col("lo").cast("string"))).alias("message_id"))
    return rows.unionByName(first.filter("number is null").select("stream", "slot", "line_no", "message_id", F.lit("malformed").alias("verdict")), allowMissingColumns=True)


def accepted(swept_lines: DataFrame, log: DataFrame) -> DataFrame:
    """``stream, message_id, slot, line_no`` of the messages of a batch that were not seen before.

    An ``accepted`` number needs no look-up; the others are new unless ``log`` has their exact key.
    """
    row = [*_KEY, "line_no"]
    sure = swept_lines.filter("verdict = 'accepted'").select(*row)
    return sure.unionByName(swept_lines.filter("verdict in ('covered', 'malformed')").select(*row).join(log.select(*_KEY), _KEY, "left_anti"))


def merged(swept_lines: DataFrame) -> DataFrame:
    """The seen ranges with the numbers of a batch merged in."""
    ranges = swept_lines.filter("run is not null").groupBy(*_BLOCK, "run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return ranges.select(*_BLOCK, "lo", "hi")


def accept(lines: DataFrame, seen: Seen, block: int = BLOCK) -> tuple[DataFrame, Seen]:
    """The messages of one batch that were not seen before (stream, message_id, slot, line_no), and what is seen after it.

    Of the copies of one message within the batch the one with the smallest line_no is accepted; a
    message in ``seen`` has none accepted. An empty batch accepts nothing and leaves the ranges.
    """
    rows = checkpoint(swept(lines, seen.ranges, block))
    new = accepted(rows, seen.log)
    return new, Seen(merged(rows), seen.log.unionByName(new))


def folded(lines: DataFrame, epochs: int = EPOCHS, block: int = BLOCK, seen: Seen | None = None) -> Seen:
    """What is seen after a whole log, folded in append order in ``epochs`` stretches of line numbers.

    The stretches follow one another, so that the smallest line number of a message is accepted.
    ``log`` of the result has one line per message.
    """
    seen = seen or nothing_seen(lines.sparkSession)
    least, most = lines.agg(F.min("line_no"), F.max("line_no")).first()
    if least is None:
        return seen
    width = (most - least) // epochs + 1
    for start in range(least, most + 1, width):
        new, after = accept(lines.filter((F.col("line_no") >= start) & (F.col("line_no") < start + width)), seen, block)
        seen = Seen(checkpoint(after.ranges), seen.log.unionByName(checkpoint(new)))
    return seen


def repeated_lines(lines: DataFrame, epochs: int = EPOCHS) -> DataFrame:
    """``stream, line_no`` of every line that is a copy of an earlier message."""
    kept = folded(lines, epochs).log.select("stream", "line_no")
    return lines.select("stream", "line_no").join(kept, ["stream", "line_no"], "left_anti").distinct()
