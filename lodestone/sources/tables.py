"""Reading the parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name`` of ``folder``, a parquet file or a folder of part files."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """The shared folder for what is written between jobs: the one the session names in ``spark.checkpoint.dir``.

    Only a local session without that setting (as in tests) gets a folder under its warehouse
    directory; on a cluster its absence is an error, as a machine's own folder is not seen by the others.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints"


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def checkpoint(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint in the folder of :func:`scratch`."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(scratch(df.sparkSession))
    return df.checkpoint(eager=True)


def fits(df: DataFrame, limit_bytes: int = 8 << 20) -> bool:
    """Whether the optimizer's size estimate of ``df`` is within ``limit_bytes``."""
    estimate = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return int(str(estimate)) <= limit_bytes


def broadcast_if_small(df: DataFrame, limit_bytes: int = 8 << 20) -> DataFrame:
    """``df`` hinted for broadcast when its estimate allows, else as it is (shuffle join)."""
    return F.broadcast(df) if fits(df, limit_bytes) else df


def broadcast_if_few(df: DataFrame, most: int = 200_000) -> DataFrame:
    """A checkpointed frame of narrow rows, hinted for broadcast when it has at most ``most`` rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def once(rows: DataFrame, key: str, most: int = 200_000) -> DataFrame:
    """``rows`` with each non-null ``key`` once; if at most ``most`` keys repeat, only their rows are shuffled."""
    rows = rows.filter(F.col(key).isNotNull())
    repeated = checkpoint(rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(key))
    if repeated.limit(most + 1).count() > most:
        return rows.dropDuplicates([key])
    few = F.broadcast(repeated)
    return rows.join(few, key, "left_anti").unionByName(rows.join(few, key, "left_semi").dropDuplicates([key]))


def broadcast_or_merge(df: DataFrame, most: int = 200_000) -> DataFrame:
    """As :func:`broadcast_if_few`; a larger frame is merged, as the other side grows by an explode that the optimizer's estimate leaves out."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df.hint("merge")
