"""Tables kept by version as plain parquet folders.

A version is written beside the older ones, its ``meta`` folder last; readers take the newest
version whose ``meta`` is complete. Nothing is moved or deleted on the way, so that a reader or a
crash finds the old version or the new one, never a part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Store:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _versions(self, done: str) -> list[int]:
        found = self._fs.globStatus(self._path(f"{self.folder}/version=*{done}"))
        return sorted(int(f.getPath().toString().split("version=")[-1].split("/")[0]) for f in found or ())

    def current(self) -> int | None:
        """The version that readers see, or null."""
        return max(self._versions("/meta/_SUCCESS"), default=None)

    def replace(self, tables: dict[str, DataFrame], model: str = "") -> int:
        """Write all tables as a new version, which is current once ``meta`` is there."""
        version = max(self._versions(""), default=0) + 1
        for name, rows in tables.items():
            rows.write.parquet(f"{self.folder}/version={version}/{name}")
        self.spark.createDataFrame([(model,)], "model string").coalesce(1).write.parquet(f"{self.folder}/version={version}/meta")
        return version

    def read(self, name: str) -> DataFrame:
        version = self.current()
        if version is None:
            raise FileNotFoundError(f"{self.folder} holds no version")
        return self.spark.read.parquet(f"{self.folder}/version={version}/{name}")


def synced(store: Store, chunks: DataFrame, changes: DataFrame, embed, model: str) -> int:
    """Bring a store to ``chunks``: vectors of unchanged files are taken over, all others are made by ``embed``.

    ``changes``: repo, path, state. Everything is embedded anew if the store is empty or was made
    by another model. ``embed`` adds ``vector`` to rows with seq, repo, path, symbol, code.
    """
    rows = chunks.select("seq", "repo", "path", "symbol", "code").dropDuplicates(["seq"])
    warm = store.current() is not None and store.read("meta").filter(F.col("model") == model).count() > 0
    if warm:
        same = changes.filter("state = 'unchanged'").select("repo", "path")
        kept = store.read("vectors").join(same, ["repo", "path"], "left_semi").select("seq", "repo", "path", "vector")
        kept = kept.join(rows.select("seq"), "seq", "left_semi")
        fresh = embed(rows.join(kept.select("seq"), "seq", "left_anti"))
        vectors = kept.withColumn("reused", kept["seq"].isNotNull()).unionByName(_made(fresh))
    else:
        vectors = _made(embed(rows))
    return store.replace({"chunks": rows, "vectors": vectors}, model)


def _made(rows: DataFrame) -> DataFrame:
    return rows.selectExpr("seq", "repo", "path", "vector", "false as reused")
