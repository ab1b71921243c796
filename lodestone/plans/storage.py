"""Queries that write and read back, and the turns of a conversation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import embedding
from lodestone.operators import corpus, dialogue
from lodestone.plans import ledgers
from lodestone.sources import jsonl
from lodestone.sources.store import Store, synced
from lodestone.sources.tables import table
from lodestone.streaming.tail import folder


def vector_codec(spark: SparkSession, d: str) -> DataFrame:
    """Vectors to bytes and back: how many of each length come back as they were."""
    rows = table(spark, d, "embeddings").select("vec_id", "embedding")
    back = rows.withColumn("blob", embedding.encoded("embedding")).withColumn("again", embedding.decoded("blob"))
    return back.groupBy(F.octet_length("blob").alias("bytes")).agg(F.count(F.lit(1)).alias("vectors"), F.count_if(F.col("again") == F.col("embedding")).alias("equal"))


def ledger_jsonl(spark: SparkSession, d: str) -> DataFrame:
    """The ledger written as JSON lines by two appends and scanned: lines of each kind, ids and tokens."""
    at = folder(spark, "jsonl")
    entries = table(spark, d, "query_log").select(F.col("query_id").alias("queryId"), F.col("ts").cast("double").alias("ts"), "consumer", F.col("query_text").alias("query"), F.col("result_count").alias("resultCount"), "band", "answered", "tokens", F.col("est_cost").alias("estCost"), F.col("latency_ms").alias("latencyMs"))
    outcomes = table(spark, d, "ledger_outcomes").select(F.col("query_id").alias("queryId"), "answered", "tokens", F.col("est_cost").alias("estCost"))
    jsonl.append(entries, at)
    jsonl.append(outcomes, at)
    return jsonl.scan(spark, at).groupBy("kind").agg(F.count(F.lit(1)).alias("lines"), F.count_distinct("queryId").alias("ids"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))


def store_sync(spark: SparkSession, d: str) -> DataFrame:
    """A store brought from one snapshot of the files to a later one: chunks by state of their file, and how many vectors were taken over."""
    chunks, files = table(spark, d, "chunks"), table(spark, d, "source_files")
    before, now = corpus.snapshot(files, ledgers.THEN), corpus.snapshot(files, ledgers.NOW)
    within = lambda snap: chunks.join(snap.select("repo", "path"), ["repo", "path"], "left_semi")
    embed = lambda rows: embedding.hashed(rows, F.col("symbol"), 32)
    store, changes = Store(spark, folder(spark, "store")), corpus.changes(before, now)
    synced(store, within(before), changes, embed, "hashed-32")
    synced(store, within(now), changes, embed, "hashed-32")
    joined = store.read("vectors").join(changes, ["repo", "path"])
    return joined.groupBy("state").agg(F.count(F.lit(1)).alias("chunks"), F.count_if("reused").alias("reused"))


def history_window(spark: SparkSession, d: str) -> DataFrame:
    """The last six lines of each writer as turns; a refused one at their head is left out."""
    turns = table(spark, d, "query_log").filter("writer is not null").select("writer", "line_no", F.when(F.col("band") == "refuse", "assistant").otherwise("user").alias("role"), "query_text").dropDuplicates(["line_no"])
    kept = dialogue.recent(turns, "writer", "line_no")
    earlier = F.count(F.lit(1)).over(Window.partitionBy("writer").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1))
    return kept.withColumn("rewrite", dialogue.needs_rewrite(F.col("query_text"), earlier)).select("writer", "line_no", "role", "rewrite")


QUERIES = {f.__name__: f for f in (vector_codec, ledger_jsonl, store_sync, history_window)}

ORACLES = {
    "vector_codec": "select (4 * len(embedding))::int bytes, count(*) vectors, count(*) equal from embeddings group by 1",
    "ledger_jsonl": """select 'entry' kind, count(*) lines, count(distinct query_id) ids, coalesce(sum(tokens), 0)::bigint tokens from query_log where query_id is not null and ts is not null
      union all select 'outcome', count(*), count(distinct query_id), coalesce(sum(tokens), 0)::bigint from ledger_outcomes where query_id is not null and answered is not null""",
    "store_sync": f"with {ledgers._CHANGES}, c as (select distinct seq, repo, path from chunks) select state, count(*) chunks, count(*) filter (state = 'unchanged') reused from c join chg using (repo, path) where state <> 'deleted' group by state",
    "history_window": rf"""with l as (select distinct writer, line_no, query_text, case when band = 'refuse' then 'assistant' else 'user' end "role" from query_log where writer is not null),
      r as (select *, row_number() over (partition by writer order by line_no desc) age from l), k as (select *, min(line_no) over (partition by writer) f, row_number() over (partition by writer order by line_no) n from r where age <= 6),
      g as (select *, row_number() over (partition by writer order by line_no) m from k where line_no > f or "role" <> 'assistant')
      select writer, line_no, "role", coalesce(m > 1 and trim(query_text) <> ''
        and not regexp_matches(trim(query_text), '[a-z][a-zA-Z0-9]*[A-Z]|[a-z0-9]+_[a-z0-9]+|`[^`]+`|\b\w+\(\)|\b[\w/.-]+\.(?:ts|mts|cts|tsx|js|jsx)\b|\b[A-Z][a-z]+[A-Z][a-zA-Z]*\b')
        and regexp_matches(trim(query_text), '(?i)^(and|but|or|so|then|also|plus)\b|^(what|how)\s+about\b|\b(it|its|they|them|those|these)\b|\b(this|that)\s+(one|function|class|method|file|code|module|thing|part|error|test|change|approach|logic)\b'), false) rewrite from g""",
}
