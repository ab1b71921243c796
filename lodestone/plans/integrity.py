"""Queries on message delivery and reference integrity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import delivery, references
from lodestone.sources.tables import table


def _lines(spark: SparkSession, d: str) -> DataFrame:
    log = delivery.keyed_lines(table(spark, d, "query_log"), "query_log", ts_col="ts")
    return log.unionByName(delivery.keyed_lines(table(spark, d, "ledger_outcomes"), "ledger_outcomes"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return delivery.repeated_lines(_lines(spark, d)).withColumnRenamed("stream", "src_table")


def p2_ranges(spark: SparkSession, d: str) -> DataFrame:
    return delivery.folded(_lines(spark, d)).ranges.select("stream", "producer", "block", "lo", "hi")


def _references(spark: SparkSession, d: str) -> DataFrame:
    return references.chunk_references(table(spark, d, "chunks")).unionByName(
        references.chunk_references(table(spark, d, "chunk_rows"), "chunk_rows", "row_seq", "stored_at")
    )


def _events(spark: SparkSession, d: str) -> DataFrame:
    return references.parent_events(table(spark, d, "symbol_entries"), table(spark, d, "source_files"))


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    return references.orphan_references(_references(spark, d), _events(spark, d), table(spark, d, "externals"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).drop("at")


def p3_counts(spark: SparkSession, d: str) -> DataFrame:
    return references.orphan_counts(_orphans(spark, d)).withColumn("period", F.date_format("period", "yyyy-MM"))


def p3_waiting(spark: SparkSession, d: str) -> DataFrame:
    waiting = references.pending_by_period(_references(spark, d).dropDuplicates(["src_table", "seq", "ref_kind", "ref_value"]), _events(spark, d), table(spark, d, "externals"))
    return waiting.withColumn("period", F.date_format("period", "yyyy-MM"))


QUERIES = {"p2_found": p2_found, "p2_ranges": p2_ranges, "p3_found": p3_found, "p3_counts": p3_counts, "p3_waiting": p3_waiting}

_IDS = r"lower(regexp_replace(regexp_replace(query_id, '^\s+', ''), '\s+$', ''))"
_LINES = f"""lines as (
  select 'query_log' src_table, line_no, {_IDS} id, floor(ts / 1000)::bigint slot from query_log where query_id is not null and ts is not null
  union all
  select 'ledger_outcomes', line_no, {_IDS}, 0 from ledger_outcomes where query_id is not null)"""


def _plain_path(path: str) -> str:
    """SQL: ``path`` collapsed, ending left off; ``..`` is undone by repeated replacement."""
    slash = rf"regexp_replace(regexp_replace('/' || {path}, '/(\.?/)+', '/', 'g'), '/(\.?/)+', '/', 'g')"
    up = reduce(lambda x, _: rf"regexp_replace({x}, '/[^/]+/\.\.(/|$)', '/')", range(8), slash)
    top = rf"regexp_replace({up}, '^(/\.\.)+(/|$)', '/')"
    return rf"regexp_replace(regexp_replace({top}, '^/+', ''), '\.(ts|tsx|js|jsx|mts|cts|mjs|cjs)$', '')"


_ORPHANS = f"""refs as (
  select 'chunks' src_table, seq, repo, path, indexed_at at_, 'calls' ref_kind, unnest(structural_refs.calls) ref_value from chunks
  union all select 'chunks', seq, repo, path, indexed_at, 'imports', unnest(structural_refs.imports) from chunks
  union all select 'chunk_rows', row_seq, repo, path, stored_at, 'calls', unnest(json_extract_string(j, '$.calls[*]')) from j
  union all select 'chunk_rows', row_seq, repo, path, stored_at, 'imports', unnest(json_extract_string(j, '$.imports[*]')) from j),
r as (select distinct *, case ref_kind when 'calls' then ref_value else {_plain_path(r"regexp_replace(coalesce(path, ''), '[^/]*$', '') || ref_value")} end as name_
  from refs where ref_value is not null and (ref_kind = 'calls' or starts_with(ref_value, '.'))),
f as (select distinct repo, {_plain_path('path')} as name_, added_at, deleted_at from source_files),
orphans as (select src_table, seq, ref_kind, ref_value, at_ from r where case ref_kind
  when 'imports' then not exists (select 1 from f where f.repo = r.repo and f.name_ = r.name_ and f.added_at <= r.at_ and (f.deleted_at is null or f.deleted_at > r.at_))
  else not exists (select 1 from externals x where x.callee = r.ref_value) and case
    when exists (select 1 from symbol_entries s where s.repo = r.repo and s.symbol = r.ref_value)
    then not exists (select 1 from symbol_entries s where s.repo = r.repo and s.symbol = r.ref_value and s.first_seen <= r.at_ and (s.deleted_at is null or s.deleted_at > r.at_))
    else not exists (select 1 from symbol_entries s where s.repo = r.repo and list_extract(string_split(s.symbol, '.'), -1) = r.ref_value and s.first_seen <= r.at_ and (s.deleted_at is null or s.deleted_at > r.at_)) end end)"""
_JSON = "j as (select row_seq, repo, path, stored_at, case when json_valid(structural_refs) and json_type(structural_refs) = 'OBJECT' then structural_refs end j from chunk_rows)"

ORACLES = {
    "p2_found": f"with {_LINES}, first as (select src_table, id, slot, min(line_no) keep from lines group by all) select distinct src_table, line_no from lines join first using (src_table, id, slot) where line_no > keep",
    "p2_ranges": rf"""with {_LINES}, n as (select distinct src_table as stream, regexp_extract(id, '^(.+):q(0|[1-9][0-9]{{0,14}})$', 1) producer, regexp_extract(id, '^(.+):q(0|[1-9][0-9]{{0,14}})$', 2) q from lines),
      m as (select stream, producer, q::bigint as num, (q::bigint // 4096) block from n where producer <> ''),
      i as (select *, num - row_number() over (partition by stream, producer, block order by num) island from m)
      select stream, producer, block, min(num) lo, max(num) hi from i group by stream, producer, block, island""",
    "p3_found": f"with {_JSON}, {_ORPHANS} select src_table, seq, ref_kind, ref_value from orphans",
    "p3_counts": f"with {_JSON}, {_ORPHANS} select src_table, strftime(at_, '%Y-%m') period, ref_kind, count(*) orphans from orphans group by all",
    "p3_waiting": f"""with {_JSON}, {_ORPHANS.split("orphans as (")[0].rstrip().rstrip(",")},
      ro as (select distinct src_table, seq, ref_kind, ref_value, repo, name_, coalesce(at_, timestamp '1900-01-01') at_ from r where ref_kind = 'imports' or ref_value not in (select callee from externals where callee is not null)),
      ti as (select at_ from ro where at_ > timestamp '1900-01-01' union all select first_seen from symbol_entries where repo is not null and symbol is not null union all select deleted_at from symbol_entries where repo is not null and symbol is not null
        union all select added_at from source_files where repo is not null and path is not null union all select deleted_at from source_files where repo is not null and path is not null),
      mo as (select unnest(generate_series(date_trunc('month', min(at_)), date_trunc('month', max(at_)), interval 1 month)) m from ti where at_ is not null),
      nm as (select distinct repo, symbol from symbol_entries),
      al as (select distinct m, 'imports' ref_kind, repo, name_, false whole from mo join f on f.added_at < m + interval 1 month and (f.deleted_at is null or f.deleted_at >= m + interval 1 month)
        union select distinct m, 'calls', repo, symbol, true from mo join symbol_entries s on s.first_seen < m + interval 1 month and (s.deleted_at is null or s.deleted_at >= m + interval 1 month)
        union select distinct m, 'calls', repo, list_extract(string_split(symbol, '.'), -1), false from mo join symbol_entries s on contains(symbol, '.') and s.first_seen < m + interval 1 month and (s.deleted_at is null or s.deleted_at >= m + interval 1 month)
          and not exists (select 1 from nm where nm.repo = s.repo and nm.symbol = list_extract(string_split(s.symbol, '.'), -1))),
      ct as (select m, ro.ref_kind, src_table, count(*) n from mo join ro on ro.at_ < m + interval 1 month where not exists (select 1 from al where al.m = mo.m and al.ref_kind = ro.ref_kind and al.repo = ro.repo and al.name_ = ro.name_) group by all)
      select k.ref_kind, strftime(mo.m, '%Y-%m') period, t.src_table, coalesce(n, 0)::bigint waiting from mo cross join (values ('calls'), ('imports')) k(ref_kind) cross join (values ('chunks'), ('chunk_rows')) t(src_table) left join ct on ct.m = mo.m and ct.ref_kind = k.ref_kind and ct.src_table = t.src_table""",
}
