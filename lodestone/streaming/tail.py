"""Continuous ledger views with Structured Streaming.

Each stream runs with a checkpoint below the folder that the session names, so that it goes on
after the loss of executors or of the driver.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import delivery, ledger
from lodestone.sources.tables import checkpoint, remove, scratch, table

PARTS = 64


def folder(spark: SparkSession, name: str) -> str:
    """A new folder for a stream's state and output."""
    return f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"


def stream(spark: SparkSession, data: str, name: str) -> DataFrame:
    """A table as a stream of rows: the part files of its folder, or its only file."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{data}/{name}.parquet")
    reader = spark.readStream.schema(table(spark, data, name).schema)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        return reader.parquet(path.toString())
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(data)


def run_to_end(rows: DataFrame, name: str) -> DataFrame:
    """Run a stream over all that is there now, and read what it has written."""
    spark = rows.sparkSession
    at = folder(spark, name)
    query = rows.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{at}/out")


def first_seen(rows: DataFrame, keys: list[str], time: str, delay: str = "3650 days") -> DataFrame:
    """Each key's first row; state is dropped ``delay`` after the newest row, so a key may come again after that."""
    return rows.withColumn("_time", F.col(time).cast("timestamp")).withWatermark("_time", delay).dropDuplicatesWithinWatermark(keys).drop("_time")


def accepted_messages(batches: DataFrame, into: str) -> None:
    """Write the messages of a stream of keyed lines once each, whatever batch repeats them.

    ``batches``: the columns of :func:`lodestone.operators.delivery.keyed_lines`. Batch ``n`` reads
    the ranges of version ``n - 1`` and only accepted keys of batches below ``n``, so that a batch
    that runs again after a failure sees what it saw before and overwrites its own files. The log is
    partitioned by a hash of the key, of which only the parts that a look-up needs are read.
    """

    def step(lines: DataFrame, number: int) -> None:
        session = lines.sparkSession
        ranges = session.read.schema(delivery.RANGES).parquet(f"{into}/ranges/{number - 1}") if number else session.createDataFrame([], delivery.RANGES)
        rows = checkpoint(delivery.swept(lines, ranges))
        part = F.pmod(F.xxhash64("message_id"), F.lit(PARTS)).cast("int")
        asked = [r[0] for r in rows.filter("verdict in ('covered', 'malformed')").select(part).distinct().collect()]  # at most PARTS
        log = session.read.schema(f"{delivery.LOG}, batch long, part int").option("basePath", f"{into}/accepted").parquet(f"{into}/accepted") if number else session.createDataFrame([], f"{delivery.LOG}, batch long, part int")
        new = delivery.accepted(rows, log.filter((F.col("batch") < number) & F.col("part").isin(asked)))
        new.withColumn("part", part).write.mode("overwrite").partitionBy("part").parquet(f"{into}/accepted/batch={number}")
        delivery.merged(rows).write.mode("overwrite").parquet(f"{into}/ranges/{number}")
        if number > 1:
            remove(session, f"{into}/ranges/{number - 2}")

    query = batches.writeStream.foreachBatch(step).option("checkpointLocation", f"{into}/state").trigger(availableNow=True).start()
    query.awaitTermination()


def ledger_lines(entries: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The lines of both ledger tables as one: ``kind``, the position, and the fields of either (null where a table lacks them)."""
    place = ["line_no", "arrived_at", "query_id"]
    later = ["answered", "tokens", "est_cost"]
    one = entries.select(F.lit("entry").alias("kind"), *place, *ledger.FIELDS, *later)
    return one.unionByName(outcomes.select(F.lit("outcome").alias("kind"), *place, *later), allowMissingColumns=True)


def reconciled_feed(lines: DataFrame, into: str) -> None:
    """For every micro-batch of :func:`ledger_lines`, the reconciled row of each query id that has a new line.

    The lines so far lie below ``into``, by batch and a hash of the query id; a batch reads the parts of its own
    ids up to itself, so that one which runs again after a failure gives the same rows and overwrites its own files.
    """

    def step(fresh: DataFrame, number: int) -> None:
        session = fresh.sparkSession
        part = F.pmod(F.xxhash64("query_id"), F.lit(PARTS)).cast("int")
        kept = fresh.filter("query_id is not null").withColumn("part", part)
        kept.write.mode("overwrite").partitionBy("part").parquet(f"{into}/lines/batch={number}")
        kind = ", ".join(f"{c} {t}" for c, t in [*fresh.dtypes, ("batch", "bigint"), ("part", "int")])
        lines = session.read.schema(kind).option("basePath", f"{into}/lines").parquet(f"{into}/lines")
        new = lines.filter(F.col("batch") == number)
        parts = [r[0] for r in new.select("part").distinct().collect()]  # at most PARTS
        known = lines.filter((F.col("batch") <= number) & F.col("part").isin(parts)).join(new.select("query_id").distinct(), "query_id", "left_semi")
        rows = ledger.reconciled(known.filter("kind = 'entry'"), known.filter("kind = 'outcome'"))
        rows.write.mode("overwrite").parquet(f"{into}/feed/batch={number}")

    lines.writeStream.foreachBatch(step).option("checkpointLocation", f"{into}/feed_state").trigger(availableNow=True).start().awaitTermination()
