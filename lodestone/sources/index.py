"""The search index as plain parquet folders, made once per state of the chunks and read by every search.

``postings`` are spread by term and a hash of the document, so that a word of every document is
in no single part, and sorted by term, so that a look-up reads few row groups. ``docs`` holds the
lengths, ``vectors`` the embedded texts, ``nodes``, ``members`` and ``links`` the call graph. Each
part is written when it is first read; one that was not written to its end is written again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import embedding
from lodestone.operators import graph, lexical
from lodestone.sources.tables import once, scratch, table

#: Postings in one part, and the parts that one term is spread over.
ROWS, SPREAD = 2_000_000, 8


class Index:
    """The parts of the index of a chunk table below ``folder``; null ids are left out, repeated rows count once."""

    def __init__(self, chunks: DataFrame, folder: str):
        self.chunks, self.folder, self.spark = chunks, folder, chunks.sparkSession

    def _part(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        at = f"{self.folder}/{name}"
        done = self.spark._jvm.org.apache.hadoop.fs.Path(f"{at}/_SUCCESS")
        if not done.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(done):
            make().write.mode("overwrite").parquet(at)
        return self.spark.read.parquet(at)

    @property
    def tokens(self) -> DataFrame:
        return self._part("tokens", lambda: lexical.indexed(self.chunks))

    @property
    def docs(self) -> DataFrame:
        return self._part("docs", lambda: self.tokens.select("doc", "n_tokens"))

    @property
    def postings(self) -> DataFrame:
        def make() -> DataFrame:
            parts = max(1, -(-(self.docs.agg(F.sum("n_tokens")).first()[0] or 0) // ROWS))
            return lexical.postings(self.tokens).repartition(parts, "term", F.pmod(F.xxhash64("doc"), F.lit(SPREAD))).sortWithinPartitions("term", "doc")

        return self._part("postings", make)

    @property
    def vectors(self) -> DataFrame:
        def make() -> DataFrame:
            texts = once(self.chunks.select(F.col("seq").alias("id"), "symbol", "code"), "id")
            return embedding.hashed(texts, F.concat_ws(" ", "symbol", "code")).select("id", "vector")

        return self._part("vectors", make)

    @property
    def nodes(self) -> DataFrame:
        return self._part("nodes", lambda: graph.nodes(self.chunks))

    @property
    def members(self) -> DataFrame:
        return self._part("members", lambda: graph.members(self.nodes))

    @property
    def links(self) -> DataFrame:
        return self._part("links", lambda: graph.links(self.nodes))


def opened(spark: SparkSession, data: str) -> Index:
    """The index of a data folder's chunks, of this session and of the table's present files."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{data}/chunks.parquet")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    state = [(f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in files.listStatus(path)]
    name = hashlib.md5(repr((spark.sparkContext.applicationId, data, state)).encode()).hexdigest()
    return Index(table(spark, data, "chunks"), f"{scratch(spark)}/index-{name}")
