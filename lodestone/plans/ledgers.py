"""Queries of the ledger, the corpus overviews, suggestions and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text
from lodestone.operators import corpus, evaluation, ledger, suggest
from lodestone.plans import hybrid, integrity, retrieval
from lodestone.sources import chunker
from lodestone.sources.tables import table
from lodestone.streaming import tail

APPENDS = 3
THEN, NOW = "2025-04-01 00:00:00", "2025-06-01 00:00:00"


def _ledger(spark: SparkSession, d: str) -> DataFrame:
    return ledger.reconciled(table(spark, d, "query_log"), table(spark, d, "ledger_outcomes"))


def _rounded(rows: DataFrame) -> DataFrame:
    whole = rows.withColumn("tokens", F.coalesce("tokens", F.lit(-1))).withColumn("result_count", F.coalesce("result_count", F.lit(-1)))
    return whole.withColumn("est_cost", F.round(F.coalesce("est_cost", F.lit(-1.0)), 6)).withColumn("latency_ms", F.round(F.coalesce("latency_ms", F.lit(-1.0)), 3))


def ledger_reconcile(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_ledger(spark, d))


def ledger_newest(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(ledger.newest(_ledger(spark, d), 50, "cli"))


def ledger_latest(spark: SparkSession, d: str) -> DataFrame:
    return ledger.latest(_ledger(spark, d))


def ledger_totals(spark: SparkSession, d: str) -> DataFrame:
    return ledger.totals(_ledger(spark, d))


def feed_upsert(spark: SparkSession, d: str) -> DataFrame:
    return ledger.newest(_ledger(spark, d), 100).select("query_id", "consumer", "answered", "first_line")


def replay_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "query_log").filter("writer is not null").select("writer", "line_no", "query_id").dropDuplicates(["line_no"])
    return ledger.replay(lines, "writer")


def trace_dedup(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select("user_id", "event_type", "props", "event_id")
    return ledger.first_events(events, ["user_id", "event_type", "props"], ["event_id"])


def trace_stream(spark: SparkSession, d: str) -> DataFrame:
    rows = tail.stream(spark, d, "events").select("user_id", "event_type", "ts")
    return tail.run_to_end(tail.first_seen(rows, ["user_id", "event_type"], "ts"), "trace").select("user_id", "event_type")


def ledger_stream(spark: SparkSession, d: str) -> DataFrame:
    """The lines of both ledger tables that the batch deduplication keeps, accepted from a stream that goes on as lines are appended."""
    lines, into = integrity._lines(spark, d), tail.folder(spark, "ledger")
    most = lines.agg(F.max("line_no")).first()[0] or 0
    for k in range(APPENDS):
        a, b = k * (most + 1) // APPENDS, (k + 1) * (most + 1) // APPENDS
        lines.filter((F.col("line_no") >= a) & (F.col("line_no") < b)).write.mode("append").parquet(f"{into}/in")
        tail.accepted_messages(spark.readStream.schema(lines.schema).parquet(f"{into}/in"), into)
    return spark.read.parquet(f"{into}/accepted").select(F.col("stream").alias("src_table"), "line_no")


def ledger_feed(spark: SparkSession, d: str) -> DataFrame:
    """The ledger followed as it grows by thirds: after each, the reconciled rows of the queries with a new line."""
    lines, into = tail.ledger_lines(table(spark, d, "query_log"), table(spark, d, "ledger_outcomes")), tail.folder(spark, "feed")
    most = lines.agg(F.max("line_no")).first()[0] or 0
    for k in range(APPENDS):
        a, b = k * (most + 1) // APPENDS, (k + 1) * (most + 1) // APPENDS
        lines.filter((F.col("line_no") >= a) & (F.col("line_no") < b)).write.mode("append").parquet(f"{into}/in")
        tail.reconciled_feed(spark.readStream.schema(lines.schema).parquet(f"{into}/in"), into)
    rows = spark.read.option("basePath", f"{into}/feed").parquet(f"{into}/feed")
    return rows.select(F.col("batch").cast("int").alias("batch"), "query_id", "band", "answered", F.coalesce("tokens", F.lit(-1)).alias("tokens"), "first_line")


def walk_filter(spark: SparkSession, d: str) -> DataFrame:
    return corpus.walked(table(spark, d, "source_files"))


def ingest_telemetry(spark: SparkSession, d: str) -> DataFrame:
    return corpus.ingest_telemetry(corpus.walked(table(spark, d, "source_files")))


def ingest_languages(spark: SparkSession, d: str) -> DataFrame:
    return corpus.ingest_languages(corpus.walked(table(spark, d, "source_files")))


def ingest_errors(spark: SparkSession, d: str) -> DataFrame:
    return corpus.ingest_errors(table(spark, d, "source_files"))


def chunk_telemetry(spark: SparkSession, d: str) -> DataFrame:
    return corpus.chunk_telemetry(table(spark, d, "chunks"))


def _changes(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "source_files")
    return corpus.changes(corpus.snapshot(files, THEN), corpus.snapshot(files, NOW))


def manifest_diff(spark: SparkSession, d: str) -> DataFrame:
    return _changes(spark, d)


def warm_reuse(spark: SparkSession, d: str) -> DataFrame:
    return corpus.reusable(table(spark, d, "chunks"), _changes(spark, d))


def corpus_tree(spark: SparkSession, d: str) -> DataFrame:
    return corpus.tree(table(spark, d, "symbol_entries"))


def symbol_autocomplete(spark: SparkSession, d: str) -> DataFrame:
    idents = retrieval.query_set(spark, d).select("query_id", F.get(F.filter(text.query_symbols(F.col("query_text")), lambda t: text.is_code_shaped(t)), F.lit(0)).alias("ident"))
    return corpus.complete(table(spark, d, "symbol_entries"), idents.filter("ident is not null").select("query_id", F.substring("ident", 1, 5).alias("typed")))


def chunk_typescript(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "source_files").filter("code is not null").select("file_id", "repo", "path", "code").dropDuplicates(["file_id"])
    cut = chunker.chunked(files)
    join = lambda c: F.array_join(f"structural_refs.{c}", "|").alias(c)
    return cut.select("repo", "id", "symbol", "kind", F.length("code").alias("signs"), join("calls"), join("imports"))


def islands_of_glue(spark: SparkSession, d: str) -> DataFrame:
    return corpus.islands(table(spark, d, "chunks"))


def did_you_mean(spark: SparkSession, d: str) -> DataFrame:
    """Identifiers of the query log with their last sign cut off, so that most are near misses."""
    queries = retrieval.query_set(spark, d).select("query_id", F.regexp_replace("query_text", r"([a-z][A-Z][A-Za-z]*)[A-Za-z]\b", "$1").alias("query_text"))
    return suggest.nearest_symbols(queries, table(spark, d, "symbol_entries"))


def _evaluated(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.scores(hybrid._bm25(spark, d), hybrid.resolve_definitions(spark, d))


def recall_mrr_ndcg(spark: SparkSession, d: str) -> DataFrame:
    return _evaluated(spark, d).select("query_id", *[F.round(c, 6).alias(c) for c in ("recall", "rr", "ndcg")])


def eval_rollup(spark: SparkSession, d: str) -> DataFrame:
    consumer = table(spark, d, "query_log").select(F.col("line_no").alias("query_id"), F.coalesce("consumer", F.lit("")).alias("bucket")).dropDuplicates(["query_id"])
    return evaluation.report(_evaluated(spark, d).join(consumer, "query_id"))


QUERIES = {
    f.__name__: f
    for f in (
        ledger_reconcile, ledger_newest, ledger_latest, ledger_totals, feed_upsert, replay_lines, trace_dedup, trace_stream, ledger_stream, ledger_feed, walk_filter, ingest_telemetry, ingest_languages, ingest_errors,
        chunk_telemetry, manifest_diff, warm_reuse, corpus_tree, symbol_autocomplete, chunk_typescript, islands_of_glue, did_you_mean, recall_mrr_ndcg, eval_rollup,
    )
}

_LEDGER = """en as (select *, row(arrived_at, 0, line_no) at_ from query_log where query_id is not null),
la as (select query_id, arg_max(row(consumer, query_text, result_count, band, latency_ms, answered, tokens, est_cost), row(at_, line_no)) f, max(at_) since, arg_min(line_no, at_) first_line from en group by 1),
ou as (select o.query_id, o.answered, o.tokens, o.est_cost, row(o.arrived_at, 1, o.line_no) at_ from ledger_outcomes o join la using (query_id) where row(o.arrived_at, 1, o.line_no) > since),
lt as (select query_id, arg_max(answered, at_) filter (answered is not null) la, arg_max(tokens, at_) filter (tokens is not null) lt, arg_max(est_cost, at_) filter (est_cost is not null) lc from ou group by 1),
ld as (select query_id, f[1] consumer, f[2] query_text, f[3] result_count, f[4] band, round(f[5], 3) latency_ms, coalesce(la, f[6]) answered, coalesce(lt, f[7]) tokens, round(coalesce(lc, f[8]), 6) est_cost, first_line from la left join lt using (query_id))"""
_WHOLE = "* replace (coalesce(tokens, -1) as tokens, coalesce(result_count, -1) as result_count, coalesce(est_cost, -1) as est_cost, coalesce(latency_ms, -1) as latency_ms)"
_WALK = r"""wk as (select distinct file_id, repo, case when regexp_matches(path, '\.d\.[mc]?ts$') then 'declaration' when size_bytes > 1000000 then 'too-large' when contains(substr(code, 1, 8192), chr(0)) then 'binary' when code is null then 'read-error' end reason
  from source_files where regexp_matches(path, '\.(ts|mts|cts)$') and not regexp_matches('/' || path || '/', '/(node_modules|\.git|dist|build|coverage|out|\.next|\.cache|\.turbo)/'))"""


def _at(time: str) -> str:
    return f"select distinct repo, path, least(mtime_ms, epoch_ms(timestamp '{time}')::double) m, size_bytes s from source_files where added_at <= timestamp '{time}' and (deleted_at is null or deleted_at > timestamp '{time}')"


_CHANGES = f"""was as ({_at(THEN)}), cur as ({_at(NOW)}),
chg as (select coalesce(was.repo, cur.repo) repo, coalesce(was.path, cur.path) path, case when was.path is null then 'new' when cur.path is null then 'deleted' when was.m = cur.m and was.s is not distinct from cur.s then 'unchanged' else 'changed' end state from was full join cur on was.repo = cur.repo and was.path = cur.path)"""
_KEY = r"array_to_string(list_sort(list_filter(string_split(lower(regexp_replace(regexp_replace({0}, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '[_\s]+', ' ', 'g')), ' '), lambda x: x <> '')), ' ')"
_EVAL = f"""{hybrid.SEARCH},
tt as (select query_id, count(*) total from df group by 1),
hh as (select query_id, count(*) filter ("rank" <= 10) hits, sum(1 / log2("rank" + 1)) filter ("rank" <= 10) dcg, min("rank") first_ from bm join df using (query_id, doc) group by 1),
ev as (select query_id, coalesce(hits, 0) / total recall, coalesce(1 / first_, 0) rr, coalesce(dcg, 0) / list_sum(list_transform(range(1, least(total, 10) + 1), lambda i: 1 / log2(i + 1))) ndcg from tt left join hh using (query_id))"""

ORACLES = {
    "ledger_reconcile": f"with {_LEDGER} select {_WHOLE} from ld",
    "ledger_newest": f"with {_LEDGER} select {_WHOLE} from ld where consumer = 'cli' order by first_line desc limit 50",
    "ledger_latest": f"with {_LEDGER} select 'retrieve' layer, arg_max(query_id, first_line) query_id from ld union all select 'answer', arg_max(query_id, first_line) filter (answered) from ld",
    "ledger_totals": f"with {_LEDGER} select consumer, band, count(*) queries, count(*) filter (answered) answered, sum(tokens)::bigint tokens, round(avg(latency_ms), 3) mean_latency, grouping(consumer, band)::int \"level\" from ld group by rollup (consumer, band)",
    "feed_upsert": f"with {_LEDGER} select query_id, consumer, answered, first_line from ld order by first_line desc limit 100",
    "replay_lines": "with l as (select distinct writer, line_no, query_id from query_log where writer is not null) select *, row_number() over (partition by writer order by line_no desc)::int age from l qualify age <= 50",
    "trace_dedup": "select user_id, event_type, props, min(event_id) event_id from events group by all",
    "trace_stream": "select distinct user_id, event_type from events",
    "walk_filter": f"with {_WALK} select file_id, repo, 'typescript' lang, reason from wk",
    "ingest_telemetry": f"with {_WALK} select repo, count(*) walked, count(*) filter (reason is null) indexed, count(*) filter (reason in ('declaration', 'too-large', 'binary')) skipped, count(*) filter (reason = 'read-error') errors from wk group by 1",
    "ingest_languages": f"with {_WALK} select 'typescript' lang, count(*) files, 1 place from wk where reason is null having count(*) > 0",
    "ingest_errors": f"with {_WALK.replace('file_id, repo, case', 'file_id, repo, path, case')} select distinct repo, path || ': ' || reason error from wk where reason = 'read-error'",
    "chunk_telemetry": "with c as (select distinct seq, kind, coalesce(lang, '') lang from chunks) select kind, lang, count(*) chunks, grouping(kind, lang)::int \"level\" from c group by cube (kind, lang)",
    "manifest_diff": f"with {_CHANGES} select * from chg",
    "warm_reuse": f"with {_CHANGES}, c as (select distinct seq, repo, path from chunks) select seq, state = 'unchanged' reuse from c join chg using (repo, path) where state in ('unchanged', 'changed')",
    "corpus_tree": "with f as (select repo, path, count(distinct symbol) symbols, string_split(path, '/') p from symbol_entries where path is not null and path <> '' group by all), e as (select *, unnest(range(0, len(p))) depth from f) select repo, array_to_string(p[1:depth], '/') folder, depth::int depth, count(*) files, sum(symbols)::bigint symbols from e group by all",
    "symbol_autocomplete": f"""with {retrieval.QUERY_SET}, s as (select symbol, lower(symbol) n, lower(coalesce(min(path), '')) p from symbol_entries where symbol is not null group by symbol),
      i as (select query_id, lower(trim(substr(list_filter(regexp_extract_all(query_text, '[A-Za-z_$][A-Za-z0-9_$]*(?:[./][A-Za-z_$][A-Za-z0-9_$]*)*'), lambda t: length(t) >= 2 and regexp_matches(t, '[./_]|[a-z][A-Z]'))[1], 1, 5))) t from qs)
      select query_id, symbol, row_number() over (partition by query_id order by case when instr(n, t) = 1 then 0 when instr(n, t) > 1 then 1 else 2 end, symbol)::int place from i join s on instr(n, t) > 0 or instr(p, t) > 0 where length(t) >= 3 qualify place <= 8""",
    "islands_of_glue": """with c as (select distinct seq, repo, path, span.start_line a, span.end_line b from chunks where span.start_line is not null and span.end_line is not null),
      r as (select *, max(b) over (partition by repo, path order by a, b, seq rows between unbounded preceding and 1 preceding) reach from c),
      o as (select *, sum(case when reach is null or a > reach + 1 then 1 else 0 end) over (partition by repo, path order by a, b, seq rows unbounded preceding) run from r)
      select repo, path, min(a) first_line, max(b) last_line, count(*) parts from o group by repo, path, run""",
    "did_you_mean": rf"""with {retrieval.QUERY_SET}, q as (select query_id, regexp_replace(query_text, '([a-z][A-Z][A-Za-z]*)[A-Za-z]\b', '\1', 'g') query_text from qs),
      i as (select distinct query_id, unnest(list_concat(regexp_extract_all(query_text, '`([^`]+)`', 1), list_filter(regexp_extract_all(query_text, '[A-Za-z][A-Za-z0-9_]*'), lambda t: regexp_matches(t, '[a-z][A-Z]|[A-Z][a-z].*[A-Z]|_')))) ident from q),
      k as (select distinct symbol from symbol_entries where length(symbol) >= 4),
      o as (select * from i where length(ident) >= 4 and query_id not in (select query_id from i join k on lower(ident) = lower(symbol) where length(ident) >= 4)),
      a as (select query_id, {_KEY.format('ident')} a from o), b as (select symbol, {_KEY.format('symbol')} b from k),
      c as (select query_id, symbol, levenshtein(a, b) / greatest(length(a), length(b)) distance from a join b on a <> '' and b <> '' where levenshtein(a, b) / greatest(length(a), length(b)) <= 0.34)
      select query_id, symbol, round(distance, 6) distance from c qualify row_number() over (partition by query_id order by round(distance, 9), length(symbol), symbol) = 1""",
    "recall_mrr_ndcg": f"with {_EVAL} select query_id, round(recall, 6) recall, round(rr, 6) rr, round(ndcg, 6) ndcg from ev",
    "eval_rollup": f"with {_EVAL}, b as (select distinct line_no query_id, coalesce(consumer, '') bucket from query_log) select case when grouping(bucket) = 1 then 'overall' else bucket end bucket, count(*) queries, round(avg(recall), 6) recall, round(avg(rr), 6) rr, round(avg(ndcg), 6) ndcg from ev join b using (query_id) group by rollup (bucket)",
}
ORACLES["ledger_stream"] = f"with {integrity._LINES} select src_table, min(line_no) line_no from lines group by src_table, id, slot"


def _grown(k: int) -> str:
    """SQL: the rows that the ledger's feed gives after its part ``k``."""
    border = lambda n: f"(select {n} * (greatest((select max(line_no) from query_log), (select max(line_no) from ledger_outcomes)) + 1) // {APPENDS})"
    upto = _LEDGER.replace("from query_log where query_id is not null", f"from query_log where query_id is not null and line_no < {border(k + 1)}").replace("from ledger_outcomes o join la using (query_id) where", f"from ledger_outcomes o join la using (query_id) where o.line_no < {border(k + 1)} and")
    fresh = " union ".join(f"select query_id from {t} where line_no >= {border(k)} and line_no < {border(k + 1)}" for t in ("query_log", "ledger_outcomes"))
    return f"select * from (with {upto} select {k} batch, query_id, band, answered, coalesce(tokens, -1) tokens, first_line from ld where query_id in ({fresh}))"


ORACLES["ledger_feed"] = " union all ".join(map(_grown, range(APPENDS)))
