"""Files of a folder tree as rows: listed, filtered, then read in parallel."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import corpus


def files(spark: SparkSession, root: str, repo: str) -> DataFrame:
    """``repo, path, mtime_ms, size_bytes, code`` of every file a walk considers, paths relative to ``root``.

    The tree is listed without opening any file; ignored folders and other endings are left out, and
    only then the rest is read. Files over the size limit are listed without their text, texts that
    are no UTF-8 are null. On a local file system, linked files and folders are not followed.
    """
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    full = base.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(base).toString().rstrip("/")
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{ts,mts,cts}").load(root).select("path", "modificationTime", "length")
    plain = lambda c: F.regexp_replace(c, "^[a-z0-9]+:/+", "/")
    inside = F.substring(plain(F.col("path")), F.length(plain(F.lit(full))) + 2, F.lit(1 << 20))
    wanted = listed.select(F.col("path").alias("uri"), inside.alias("path"), F.unix_millis("modificationTime").cast("double").alias("mtime_ms"), F.col("length").alias("size_bytes")).filter(corpus.candidate(F.col("path")))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, codes = [], []
            for uri, path, size in zip(*(batch.column(c).to_pylist() for c in ("uri", "path", "size_bytes"))):
                system, name = fs.FileSystem.from_uri(uri)
                here = name[: len(name) - len(path)]
                keep.append(not isinstance(system, fs.LocalFileSystem) or os.path.realpath(name) == os.path.join(os.path.realpath(here), path))
                try:
                    codes.append(system.open_input_file(name).read().decode() if keep[-1] and size <= corpus.MOST_BYTES else None)
                except (OSError, UnicodeDecodeError):
                    codes.append(None)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("path", "mtime_ms", "size_bytes")), pa.array(codes, pa.string())], ["path", "mtime_ms", "size_bytes", "code"]).filter(pa.array(keep))

    return wanted.mapInArrow(read, "path string, mtime_ms double, size_bytes long, code string").select(F.lit(repo).alias("repo"), "*")
