"""The ledger as JSON lines: appending, and a tolerant scan that tells entries from outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_FIELDS = "queryId string, ts double, consumer string, query string, resultCount int, band string, answered boolean, tokens bigint, estCost double, latencyMs double"


def append(rows: DataFrame, folder: str) -> None:
    """Add rows as lines; null fields are left out of a line."""
    rows.write.mode("append").option("ignoreNullFields", "true").json(folder)


def clear(spark: SparkSession, folder: str) -> None:
    """Leave a readable ledger without lines."""
    spark.createDataFrame([], _FIELDS).write.mode("overwrite").json(folder)


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """``kind`` (entry or outcome), ``file``, and the fields of every line that is one.

    An entry has a query id and a numeric time, an outcome a query id and ``answered`` but no time.
    Blank and malformed lines, and objects that are neither, are passed over.
    """
    lines = spark.read.text(folder).select("value", F.col("_metadata.file_name").alias("file"))
    parsed = lines.select("file", F.try_parse_json("value").alias("v")).filter("v is not null")
    get = lambda name, kind: F.try_variant_get("v", f"$.{name}", kind).alias(name)
    fields = parsed.select("file", *[get(*f.split(" ")) for f in _FIELDS.split(", ")])
    kind = F.when(F.col("queryId").isNotNull() & F.col("ts").isNotNull(), "entry").when(F.col("queryId").isNotNull() & F.col("answered").isNotNull(), "outcome")
    return fields.withColumn("kind", kind).filter("kind is not null")
