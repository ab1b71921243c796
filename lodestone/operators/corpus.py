"""The corpus of files: what a walk keeps, what changed between two walks, and overviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.sources.tables import broadcast_or_merge, checkpoint

#: What a walk considers, prunes and refuses.
EXTENSIONS = (".ts", ".mts", ".cts")
IGNORED = ("node_modules", ".git", "dist", "build", "coverage", "out", ".next", ".cache", ".turbo")
MOST_BYTES = 1_000_000
SNIFFED = 8192


def candidate(path: Column) -> Column:
    """Whether a walk considers a path: a known ending, and no ignored folder above it."""
    ignored = F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(x) for x in IGNORED]))
    ending = F.concat(F.lit("."), F.regexp_extract(path, r"\.([^./]+)$", 1))
    return ending.isin(*EXTENSIONS) & ~ignored


def skip_reason(path: Column, size: Column, code: Column, declarations: bool = False) -> Column:
    """Why a file is skipped, or null: declaration, too-large, binary, read-error, in this order."""
    declared = path.rlike(r"\.d\.[mc]?ts$") & F.lit(not declarations)
    return (
        F.when(declared, "declaration")
        .when(size > MOST_BYTES, "too-large")
        .when(F.contains(F.substring(code, 1, SNIFFED), F.lit("\0")), "binary")
        .when(code.isNull(), "read-error")
    )


def walked(files: DataFrame) -> DataFrame:
    """``file_id, repo, lang, reason`` of the considered files, once each; ``lang`` by the ending, null reason: included."""
    rows = files.filter(candidate(F.col("path"))).select("file_id", "repo", "path", "size_bytes", "code").dropDuplicates(["file_id"])
    return rows.select("file_id", "repo", F.when(F.col("path").rlike(r"\.[mc]?ts$"), "typescript").otherwise("unknown").alias("lang"), skip_reason(F.col("path"), F.col("size_bytes"), F.col("code")).alias("reason"))


def ingest_telemetry(walk: DataFrame) -> DataFrame:
    """Per repo: walked = indexed + skipped + errors."""
    return walk.groupBy("repo").agg(
        F.count(F.lit(1)).alias("walked"), F.count_if(F.col("reason").isNull()).alias("indexed"),
        F.count_if(F.col("reason").isin("declaration", "too-large", "binary")).alias("skipped"), F.count_if(F.col("reason") == "read-error").alias("errors"),
    )


def ingest_languages(walk: DataFrame) -> DataFrame:
    """``lang, files, place``: the included files of each language, the commonest first; ties by name."""
    each = walk.filter("reason is null").groupBy("lang").agg(F.count(F.lit(1)).alias("files"))
    return each.withColumn("place", F.row_number().over(Window.orderBy(F.desc("files"), "lang")))  # as many rows as languages


def ingest_errors(files: DataFrame) -> DataFrame:
    """``repo, error`` -- path and reason of every considered file that could not be read, once each."""
    rows = files.filter(candidate(F.col("path"))).select("repo", "path", skip_reason(F.col("path"), F.col("size_bytes"), F.col("code")).alias("reason"))
    return rows.filter("reason = 'read-error'").select("repo", F.concat_ws(": ", "path", "reason").alias("error")).distinct()


def chunk_telemetry(chunks: DataFrame) -> DataFrame:
    """``kind, lang`` with subtotals (null: all) and the number of chunks, repeated rows once."""
    rows = chunks.select("seq", "kind", F.coalesce("lang", F.lit("")).alias("lang")).dropDuplicates(["seq"])
    return rows.cube("kind", "lang").agg(F.count(F.lit(1)).alias("chunks"), F.grouping_id().cast("int").alias("level"))


def snapshot(files: DataFrame, at: str) -> DataFrame:
    """``repo, path, mtime_ms, size_bytes`` of the files that were there at a time; a later change is not yet seen."""
    time = F.lit(at).cast("timestamp_ntz")
    there = (F.col("added_at") <= time) & (F.col("deleted_at").isNull() | (F.col("deleted_at") > time))
    ms = F.unix_millis(F.to_timestamp(F.lit(at + " +00:00"))).cast("double")
    rows = files.filter(there).select("repo", "path", F.least("mtime_ms", ms).alias("mtime_ms"), "size_bytes")
    return rows.dropDuplicates(["repo", "path"])


def changes(manifest: DataFrame, current: DataFrame) -> DataFrame:
    """``repo, path, state``: unchanged, changed, new or deleted by modification time and size."""
    a = manifest.select("repo", "path", F.struct("mtime_ms", "size_bytes").alias("was"))
    b = current.select("repo", "path", F.struct("mtime_ms", "size_bytes").alias("now"))
    state = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "deleted").when(F.col("was") == F.col("now"), "unchanged").otherwise("changed")
    return a.join(b, ["repo", "path"], "full_outer").select("repo", "path", state.alias("state"))


def reusable(chunks: DataFrame, changed: DataFrame) -> DataFrame:
    """``seq, reuse`` for the chunks of files that are still there: taken over, or to be made anew."""
    rows = chunks.select("seq", "repo", "path").dropDuplicates(["seq"]).join(changed.filter("state in ('unchanged', 'changed')"), ["repo", "path"])
    return rows.select("seq", (F.col("state") == "unchanged").alias("reuse"))


def tree(symbols: DataFrame) -> DataFrame:
    """``repo, folder, depth, files, symbols`` of every folder, the root as the empty path."""
    files = symbols.filter("path is not null and path <> ''").groupBy("repo", "path").agg(F.count_distinct("symbol").alias("symbols"))
    parts = F.split("path", "/")
    folders = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    each = files.select("repo", "symbols", F.posexplode(folders).alias("depth", "folder"))
    return each.groupBy("repo", "folder", "depth").agg(F.count(F.lit(1)).alias("files"), F.sum("symbols").alias("symbols"))


def complete(symbols: DataFrame, asked: DataFrame, limit: int = 8) -> DataFrame:
    """``query_id, symbol, place``: symbols for what was typed so far (at least three signs), by name, then by path.

    Names that begin with it come first, then names that hold it, then paths that do; ties by
    symbol. Candidates come through the first three signs of what was typed.
    """
    rows = symbols.filter("symbol is not null").groupBy("symbol").agg(F.min("path").alias("path"))
    grams = lambda c: F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 2, F.lit(1))), lambda i: F.substring(c, i, F.lit(3)))
    name, place = F.lower("symbol"), F.lower(F.coalesce("path", F.lit("")))
    indexed = rows.select("symbol", name.alias("name"), place.alias("where"), F.explode(F.array_distinct(F.concat(grams(name), grams(place)))).alias("gram"))
    queries = asked.select("query_id", F.lower(F.trim("typed")).alias("typed")).filter(F.length("typed") >= 3)
    typed = broadcast_or_merge(checkpoint(queries.select("typed").distinct().withColumn("gram", F.substring("typed", 1, 3))))
    hits = indexed.join(typed, "gram").withColumn("in_name", F.expr("instr(name, typed)")).filter(F.expr("in_name > 0 or instr(where, typed) > 0"))
    kind = F.when(F.col("in_name") == 1, 0).when(F.col("in_name") > 1, 1).otherwise(2)
    ranked = hits.withColumn("place", F.row_number().over(Window.partitionBy("typed").orderBy(kind, "symbol"))).filter(F.col("place") <= limit)
    return queries.join(ranked, "typed").select("query_id", "symbol", "place")


def islands(chunks: DataFrame) -> DataFrame:
    """``repo, path, first_line, last_line, parts``: runs of chunks of a file that touch or overlap."""
    rows = chunks.select("seq", "repo", "path", F.col("span.start_line").alias("a"), F.col("span.end_line").alias("b")).filter("a is not null and b is not null").dropDuplicates(["seq"])
    order = Window.partitionBy("repo", "path").orderBy("a", "b", "seq")
    reach = F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = rows.withColumn("opens", (reach.isNull() | (F.col("a") > reach + 1)).cast("int"))
    run = opened.withColumn("run", F.sum("opens").over(order))
    return run.groupBy("repo", "path", "run").agg(F.min("a").alias("first_line"), F.max("b").alias("last_line"), F.count(F.lit(1)).alias("parts")).drop("run")
