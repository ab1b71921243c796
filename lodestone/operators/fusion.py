"""Fusing ranked lists, guaranteeing named definitions, and measuring how far results ground a query."""

from __future__ import annotations

import logging
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import text

#: The constant of reciprocal rank fusion, the legs' weights, and the floors of evidence.
RRF_K = 60
WEIGHTS = {"bm25": 0.6, "dense": 0.4, "structural": 0.3}
LEXICAL_FLOOR, COSINE_FLOOR = 0.25, 0.27


def safely(leg: Callable[[], DataFrame], spark: SparkSession, schema: str) -> DataFrame:
    """What a leg finds, or nothing if it fails: the other legs then carry the query. ``leg`` must run its job itself (end in a checkpoint)."""
    try:
        return leg()
    except Exception as failure:  # noqa: BLE001 -- whatever an embedder raises
        logging.getLogger(__name__).warning("a leg is left out: %s", str(failure)[:500])
        return spark.createDataFrame([], schema)


def ranked(scored: DataFrame, pool: int | None = None) -> DataFrame:
    """``scored`` (query_id, doc, score) with its rank; ties go to the smaller doc."""
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "doc")
    out = scored.withColumn("rank", F.row_number().over(order))
    return out.filter(F.col("rank") <= pool) if pool else out


def fuse(legs: dict[str, DataFrame], weights: dict[str, float] | None = None, k: int = RRF_K) -> DataFrame:
    """``query_id, doc, <leg>..., fused`` by reciprocal rank fusion of legs with query_id, doc, rank.

    A leg adds weight / (k + rank) for each occurrence of a document; a leg that lacks it adds 0.
    ``cosine`` of a leg that has it is kept, null elsewhere. Rows lie by query, as all that follows needs them.
    """
    weights = weights or WEIGHTS
    kept = ["cosine"] if any("cosine" in df.columns for df in legs.values()) else []
    own = lambda df: [F.col(c) if c in df.columns else F.lit(None).cast("double").alias(c) for c in kept]
    each = reduce(DataFrame.unionByName, (df.select("query_id", "doc", F.lit(n).alias("leg"), (F.lit(weights[leg]) / (k + F.col("rank"))).alias("part"), *own(df)) for n, (leg, df) in enumerate(legs.items())))
    parts = each.repartition("query_id").groupBy("query_id", "doc").agg(*[F.sum(F.when(F.col("leg") == n, F.col("part")).otherwise(0.0)).alias(leg) for n, leg in enumerate(legs)], *[F.max(c).alias(c) for c in kept])
    return parts.withColumn("fused", reduce(Column.__add__, [F.col(leg) for leg in legs]))


def guaranteed(fused: DataFrame, defined: DataFrame, limit: int = 10) -> DataFrame:
    """``query_id, doc, ..., rank`` -- the first ``limit`` by fused score, definitions ranked behind taking the last places.

    A rescue takes a place from the tail even where a definition stands there, and at most ``limit`` are rescued.
    """
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("fused", 9)), "doc")
    placed = fused.join(defined.select("query_id", "doc", F.lit(True).alias("defined")), ["query_id", "doc"], "left").withColumn("place", F.row_number().over(order))
    late = placed.withColumn("late", F.coalesce("defined", F.lit(False)) & (F.col("place") > limit))
    rescued = F.least(F.sum(F.col("late").cast("int")).over(Window.partitionBy("query_id")), F.lit(limit))
    turn = F.sum(F.col("late").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    kept = late.withColumn("rescued", rescued).withColumn("turn", turn).filter((F.col("place") <= limit - F.col("rescued")) | F.col("late") & (F.col("turn") <= limit))
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("place"))).drop("defined", "place", "late", "rescued", "turn")


def grounding(results: DataFrame, queries: DataFrame, chunks: DataFrame, first: int = 10) -> DataFrame:
    """``query_id, terms, found, lexical, files, band``: which share of a query's significant words its results hold.

    A query without significant words, or without results, has lexical 0. If the results carry ``cosine``
    (null: no candidate of the vectors), ``semantic`` is the largest of the first three, 0 if all are null.
    ``band`` tells whether the evidence reaches the lexical or the cosine floor; results without vectors
    have the lexical one only. ``files`` counts distinct paths among the first five.
    """
    texts = chunks.select(F.col("seq").alias("doc"), "path", "symbol", "code").dropDuplicates(["doc"])
    held = results.filter(F.col("rank") <= first).join(texts, "doc")
    word = held.select("query_id", "rank", "path", F.array_distinct(F.regexp_extract_all(F.lower(F.concat_ws(" ", "symbol", "code")), F.lit(r"([a-z0-9]+)"), 1)).alias("words"))
    per_query = word.groupBy("query_id").agg(F.array_distinct(F.flatten(F.collect_list("words"))).alias("words"), F.count_distinct(F.when(F.col("rank") <= 5, F.col("path"))).alias("files"))
    asked = queries.select("query_id", text.significant_terms(F.col("query_text")).alias("wanted"))
    both = asked.join(per_query, "query_id", "left")
    found = F.size(F.array_intersect("wanted", F.coalesce("words", F.array().cast("array<string>"))))
    out = both.select("query_id", F.size("wanted").alias("terms"), found.alias("found"), F.coalesce("files", F.lit(0)).cast("int").alias("files"))
    lexical = F.when(F.col("terms") > 0, F.col("found") / F.col("terms")).otherwise(0.0)
    out, enough = out.withColumn("lexical", lexical), F.col("lexical") >= LEXICAL_FLOOR
    if "cosine" in results.columns:
        near = results.filter("rank <= 3").groupBy("query_id").agg(F.max("cosine").alias("semantic"))
        out = out.join(near, "query_id", "left").withColumn("semantic", F.coalesce("semantic", F.lit(0.0)))
        enough = enough | (F.col("semantic") >= COSINE_FLOOR)
    return out.withColumn("band", F.when(enough, "answer").otherwise("refuse"))


def telemetry(results: DataFrame, queries: DataFrame, chunks: DataFrame, most: int = 12) -> DataFrame:
    """``query_id, result_count, bm25, dense, structural, result_paths`` for every query.

    The scores are what each leg added to the first result, 0 without results; the paths are the
    distinct ones in order of rank, at most ``most`` as a ledger line has them.
    """
    paths = chunks.select(F.col("seq").alias("doc"), "path").dropDuplicates(["doc"])
    each = results.join(paths, "doc").groupBy("query_id", "path").agg(F.min("rank").alias("rank"))
    listed = each.groupBy("query_id").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("rank", "path"))), lambda x: x["path"]), 1, most).alias("result_paths"))
    legs = [c for c in WEIGHTS if c in results.columns]
    first = results.groupBy("query_id").agg(F.count(F.lit(1)).cast("int").alias("result_count"), *[F.sum(F.when(F.col("rank") == 1, F.col(c))).alias(c) for c in legs])
    out = queries.select("query_id").join(first, "query_id", "left").join(listed, "query_id", "left")
    return out.select("query_id", F.coalesce("result_count", F.lit(0)).alias("result_count"), *[F.coalesce(c, F.lit(0.0)).alias(c) for c in legs], F.coalesce("result_paths", F.array().cast("array<string>")).alias("result_paths"))


def citation(path: Column, symbol: Column, first_line: Column, last_line: Column) -> Column:
    return F.format_string("%s (%s:%d-%d)", symbol, path, first_line, last_line)


def context(results: DataFrame, chunks: DataFrame) -> DataFrame:
    """``query_id, citations, assembled, tokens``: the results of each query as one text, in order of rank.

    The estimate of tokens is a quarter of the text's UTF-16 length, rounded up. Results are at most the limit of the search.
    """
    texts = chunks.select(F.col("seq").alias("doc"), "path", "symbol", "code", F.col("span.start_line").alias("a"), F.col("span.end_line").alias("b")).dropDuplicates(["doc"])
    part = F.concat(F.format_string("// %s:%d-%d — %s\n", "path", "a", "b", "symbol"), F.coalesce("code", F.lit("")))
    rows = results.join(texts, "doc").select("query_id", "rank", part.alias("part"), citation(F.col("path"), F.col("symbol"), F.col("a"), F.col("b")).alias("label"))
    each = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "part", "label"))).alias("all"))
    out = each.select("query_id", F.array_join(F.transform("all", lambda x: x["label"]), "; ").alias("citations"), F.array_join(F.transform("all", lambda x: x["part"]), "\n\n").alias("assembled"))
    return out.withColumn("tokens", F.ceil(text.utf16_length(F.col("assembled")) / 4).cast("bigint"))


def checked_citations(answers: DataFrame) -> DataFrame:
    """Of ``query_id, answer, known`` the distinct ``[markers]`` that are known and unknown, and whether all is well."""
    marks = F.array_distinct(F.regexp_extract_all("answer", F.lit(r"\[([^\]]+)\]"), 1))
    out = answers.select("query_id", F.coalesce(marks, F.array().cast("array<string>")).alias("marks"), F.coalesce("known", F.array().cast("array<string>")).alias("known"))
    good, bad = F.array_intersect("marks", "known"), F.array_except("marks", "known")
    return out.select("query_id", F.size(good).alias("known"), F.size(bad).alias("unknown"), ((F.size("marks") > 0) & (F.size(bad) == 0)).alias("ok"))
