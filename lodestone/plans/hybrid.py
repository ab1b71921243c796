"""Queries of graph search and of the fused search over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import embedding
from lodestone.operators import dense, fusion, graph, lexical
from lodestone.plans import integrity, retrieval
from lodestone.sources import index
from lodestone.sources.tables import broadcast_if_few, checkpoint, table

POOL, K = 50, 10
LEGS = ("bm25", "dense", "structural")


def graph_links(spark: SparkSession, d: str) -> DataFrame:
    return index.opened(spark, d).links.withColumn("dst", F.coalesce("dst", F.lit(-1)))


def _bm25(spark: SparkSession, d: str, pool: int = POOL) -> DataFrame:
    return checkpoint(lexical.search_all(index.opened(spark, d).tokens, retrieval.query_set(spark, d), pool))


def _dense(spark: SparkSession, d: str, pool: int = POOL) -> DataFrame:
    """``query_id, doc, rank, cosine`` of the vector leg. If it fails, so does the query: without the leg its rows would be others."""
    queries = embedding.hashed(retrieval.query_set(spark, d), F.col("query_text")).select("query_id", "vector")
    near = dense.search(index.opened(spark, d).vectors, queries, pool, embedding.DIM, unique=True)
    return checkpoint(near.select("query_id", F.col("id").alias("doc"), "rank", F.col("score").alias("cosine")))


def _seeds(spark: SparkSession, d: str, pool: int = POOL) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The two legs of direct hits, and the seeds that their first ``K`` give."""
    bm25, near = _bm25(spark, d, pool), _dense(spark, d, pool)
    direct = bm25.select("query_id", "doc", "rank").unionByName(near.select("query_id", "doc", "rank"))
    return bm25, near, graph.seeds(direct, retrieval.query_set(spark, d), index.opened(spark, d).nodes, K)


def seed_union(spark: SparkSession, d: str) -> DataFrame:
    return _seeds(spark, d)[2]


def resolve_definitions(spark: SparkSession, d: str) -> DataFrame:
    return graph.definitions(retrieval.query_set(spark, d), index.opened(spark, d).nodes)


def _reach(spark: SparkSession, d: str, pool: int = POOL) -> tuple[DataFrame, DataFrame, graph.Reach]:
    """The legs of direct hits, and what their seeds reach."""
    bm25, near, seeded = _seeds(spark, d, pool)
    ix = index.opened(spark, d)
    return bm25, near, graph.reach(seeded, ix.links, ix.members)


def _legs(spark: SparkSession, d: str, pool: int = POOL) -> tuple[dict[str, DataFrame], DataFrame]:
    """All three legs, and the definitions that the queries name."""
    bm25, near, reach = _reach(spark, d, pool)
    defined = broadcast_if_few(checkpoint(resolve_definitions(spark, d)))
    return {"bm25": bm25, "dense": near, "structural": graph.pinned(reach.expanded(), defined, reach.top())}, defined


def one_hop_expand(spark: SparkSession, d: str) -> DataFrame:
    return _reach(spark, d, K)[2].expanded()


def definition_pin(spark: SparkSession, d: str) -> DataFrame:
    return _legs(spark, d, K)[0]["structural"]


def _fused(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """``query_id, doc, bm25, dense, structural, fused, cosine`` of every candidate; cosine is null for what the vector leg lacks."""
    legs, defined = _legs(spark, d)
    return fusion.fuse(legs | {"structural": fusion.ranked(legs["structural"])}), defined


def rrf_fuse(spark: SparkSession, d: str) -> DataFrame:
    fused, _ = _fused(spark, d)
    return fusion.ranked(fused.withColumn("score", F.col("fused")), POOL).select("query_id", "doc", *[F.round(c, 9).alias(c) for c in LEGS + ("fused",)], "rank")


def _results(spark: SparkSession, d: str) -> DataFrame:
    fused, defined = _fused(spark, d)
    return fusion.guaranteed(fused, defined, K)


def retrieve_topk(spark: SparkSession, d: str) -> DataFrame:
    return _results(spark, d).select("query_id", "doc", F.round("fused", 9).alias("fused"), "rank")


def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    """The first ten of each query by lexical, vector and graph legs together, named definitions guaranteed."""
    return _results(spark, d).select("query_id", "doc", "rank", *[F.round(c, 9).alias(c) for c in LEGS + ("fused",)], F.round("cosine", 6).alias("cosine"))


def grounding_gate(spark: SparkSession, d: str) -> DataFrame:
    """How far the results of all three legs ground each query, by words or by vectors."""
    out = fusion.grounding(checkpoint(_results(spark, d)), retrieval.query_set(spark, d), table(spark, d, "chunks"))
    return out.withColumns({c: F.round(c, 6) for c in ("lexical", "semantic")})


hybrid_gate = grounding_gate


def result_telemetry(spark: SparkSession, d: str) -> DataFrame:
    """What a ledger line tells of the results of each query: the leg scores of the first, and the paths."""
    out = fusion.telemetry(checkpoint(_results(spark, d)), retrieval.query_set(spark, d), table(spark, d, "chunks"))
    return out.withColumns({c: F.round(c, 9) for c in LEGS}).withColumn("result_paths", F.array_join("result_paths", "|"))


def context_assembly(spark: SparkSession, d: str) -> DataFrame:
    return fusion.context(checkpoint(_results(spark, d)), table(spark, d, "chunks"))


def enforce_citations(spark: SparkSession, d: str) -> DataFrame:
    """Texts of the documents as answers: which code spans in brackets name a path that their log lines returned."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("query_id"), F.regexp_replace("text", r"\(([^()\s]+\.ts):[0-9-]+\)", "[$1]").alias("answer"))
    cited = docs.select("query_id", F.explode(F.array_distinct(F.regexp_extract_all("answer", F.lit(r"\[([^\]]+)\]"), 1))).alias("path"))
    there = cited.join(table(spark, d, "source_files").select("path").distinct(), "path", "left_semi").groupBy("query_id").agg(F.collect_set("path").alias("known"))
    return fusion.checked_citations(docs.join(there, "query_id", "left"))


QUERIES = {f.__name__: f for f in (graph_links, seed_union, resolve_definitions, one_hop_expand, definition_pin, rrf_fuse, retrieve_topk, hybrid_search, grounding_gate, result_telemetry, context_assembly, enforce_citations)}
QUERIES["hybrid_gate"] = hybrid_gate

_PLAIN = integrity._plain_path
GRAPH = rf"""nd as (select distinct seq, repo, path, symbol, list_distinct(list_filter(coalesce(structural_refs.calls, []), lambda x: x is not null)) calls, list_distinct(list_filter(coalesce(structural_refs.imports, []), lambda x: x is not null and starts_with(x, '.'))) imports, {_PLAIN('path')} path_key from chunks where seq is not null),
im as (select distinct seq src, repo, {_PLAIN("regexp_replace(coalesce(path, ''), '[^/]*$', '') || i")} path_key from (select seq, repo, path, unnest(imports) i from nd)),
mem as (select repo, 'exact' kind, symbol "name", seq dst, path_key from nd where symbol is not null union all select repo, 'short', list_extract(string_split(symbol, '.'), -1), seq, path_key from nd where contains(symbol, '.') union all select repo, 'file', path_key, seq, path_key from nd),
ca as (select seq src, repo, unnest(calls) "name" from nd),
ky as (select repo, "name", min(kind) kind from mem where kind <> 'file' group by all),
rs as (select src, repo, kind, "name" from ca join ky using (repo, "name")),
ch as (select distinct rs.src, repo, kind, "name", dst from rs join im using (src, repo) join mem using (repo, kind, "name", path_key)),
lk as (select src, repo, 'pair' kind, "name", dst from ch union all select src, repo, kind, "name", null from rs where not exists (select 1 from ch where ch.src = rs.src and ch.repo = rs.repo and ch.kind = rs.kind and ch."name" = rs."name")
  union all select src, repo, 'file', path_key, null from im where exists (select 1 from nd where nd.repo = im.repo and nd.path_key = im.path_key)),
pr as (select src a, dst b from lk where kind = 'pair' union select lk.src, mem.dst from lk join mem using (repo, kind, "name")),
ne as (select a, b from pr where a <> b union select b, a from pr where a <> b)"""
_BOTH = "coalesce({0}, '') || ' ' || coalesce(" + retrieval._SPLIT.format("{0}") + ", '')"
_VECTOR = "('0x' || substr(md5(t), 1, 8))::bigint % 256 dim, count(*)::double n"
SEARCH = rf"""{retrieval.BM25}, {GRAPH},
dt as (select doc, unnest({retrieval._TOKENS.format(_BOTH.format("x"))}) t from (select distinct seq as doc, concat_ws(' ', symbol, code) x from chunks where seq is not null)),
dv as (select doc, {_VECTOR} from dt group by all), dn as (select doc, sqrt(sum(n * n)) l from dv group by 1),
qt_ as (select query_id, unnest({retrieval._TOKENS.format(_BOTH.format("query_text"))}) t from qs),
qv as (select query_id, {_VECTOR} from qt_ group by all), qn as (select query_id, sqrt(sum(n * n)) l from qv group by 1),
dp as (select query_id, doc, sum(qv.n * dv.n) dot from qv join dv using (dim) group by all),
cs as (select qs.query_id, d.doc, coalesce(dot / (qn.l * dn.l), 0) cosine from qs cross join (select distinct seq as doc from chunks where seq is not null) d left join dp using (query_id, doc) left join qn using (query_id) left join dn on dn.doc = d.doc),
de as (select *, row_number() over (partition by query_id order by round(cosine, 9) desc, doc) as "rank" from cs qualify "rank" <= 50),
sd as (select query_id, doc seed from bm where "rank" <= 10 union select query_id, doc from de where "rank" <= 10 union select query_id, seq from (select query_id, unnest(regexp_extract_all(query_text, '[A-Za-z0-9_]+')) symbol from qs) join nd using (symbol)),
ex as (select query_id, b doc, count(distinct seed) score from sd join ne on ne.a = sd.seed where not exists (select 1 from sd s2 where s2.query_id = sd.query_id and s2.seed = ne.b) group by all),
tq as (select query_id, unnest(l) token, generate_subscripts(l, 1) pos from (select query_id, regexp_extract_all(query_text, '[A-Za-z_$][A-Za-z0-9_$]*(?:[./][A-Za-z_$][A-Za-z0-9_$]*)*') l from qs)),
te as (select query_id, pos, seq doc from tq join nd on symbol = token where length(token) >= 2),
un as (select list_extract(string_split(symbol, '.'), -1) short, min(seq) doc from nd where symbol is not null group by 1 having count(*) = 1),
tr as (select query_id, pos, doc from tq join un on un.short = list_extract(string_split(token, '.'), -1) where length(token) >= 2 and not contains(token, '/') and regexp_matches(token, '[./_]|[a-z][A-Z]') and not exists (select 1 from nd where symbol = token)),
df as (select query_id, doc, row_number() over (partition by query_id order by min(pos), doc) pin from (select * from te union all select * from tr) group by query_id, doc),
pn as (select query_id, doc, (coalesce((select max(score) from ex where ex.query_id = df.query_id), 0) + (select count(*) from df d2 where d2.query_id = df.query_id) - pin + 1)::bigint score from df
  union all select query_id, doc, score from ex where not exists (select 1 from df where df.query_id = ex.query_id and df.doc = ex.doc)),
ps as (select *, row_number() over (partition by query_id order by score desc, doc) as "rank" from pn),
fu as (select query_id, doc, coalesce(sum(0.6 / (60 + "rank")) filter (leg = 'b'), 0) bm25, coalesce(sum(0.4 / (60 + "rank")) filter (leg = 'd'), 0) dense, coalesce(sum(0.3 / (60 + "rank")) filter (leg = 's'), 0) structural
  from (select query_id, doc, "rank", 'b' leg from bm union all select query_id, doc, "rank", 'd' from de union all select query_id, doc, "rank", 's' from ps) group by all),
ff as (select *, bm25 + dense + structural fused, row_number() over (partition by query_id order by round(bm25 + dense + structural, 9) desc, doc) place from fu),
gl as (select ff.*, (place > 10 and exists (select 1 from df where df.query_id = ff.query_id and df.doc = ff.doc)) late from ff),
gt as (select *, least(sum(late::int) over (partition by query_id), 10) rescued, sum(late::int) over (partition by query_id order by place) turn from gl),
rt as (select query_id, doc, bm25, dense, structural, fused, cosine, row_number() over (partition by query_id order by place) as "rank" from gt left join de using (query_id, doc) where place <= 10 - rescued or (late and turn <= 10)),
cx as (select distinct seq doc, path, symbol, code, span.start_line a, span.end_line b from chunks)"""

ORACLES = {
    "graph_links": f'with {GRAPH} select src, repo, kind, "name", coalesce(dst, -1) dst from lk',
    "seed_union": f"with {SEARCH} select query_id, seed from sd",
    "resolve_definitions": f"with {SEARCH} select query_id, doc, pin from df",
    "one_hop_expand": f"with {SEARCH} select query_id, doc, score from ex",
    "definition_pin": f"with {SEARCH} select query_id, doc, score from pn",
    "rrf_fuse": f'with {SEARCH} select query_id, doc, round(bm25, 9) bm25, round(dense, 9) dense, round(structural, 9) structural, round(fused, 9) fused, place as "rank" from ff where place <= 50',
    "retrieve_topk": f'with {SEARCH} select query_id, doc, round(fused, 9) fused, "rank" from rt',
    "grounding_gate": rf"""with {SEARCH}, w as (select query_id, "rank", path, list_distinct(regexp_extract_all(lower(concat_ws(' ', symbol, code)), '[a-z0-9]+')) ws from rt join cx using (doc)),
      pq as (select query_id, list_distinct(flatten(list(ws))) ws, count(distinct path) filter ("rank" <= 5) files from w group by 1),
      sg as (select query_id, list_distinct(list_filter(regexp_extract_all(lower(query_text), '[a-z0-9]+'), lambda x: length(x) >= 3 and x not in ({retrieval._STOP}))) want from qs),
      g as (select query_id, len(want)::int terms, len(list_intersect(want, coalesce(ws, [])))::int found, coalesce(files, 0)::int files from sg left join pq using (query_id)),
      sm as (select query_id, max(cosine) s from rt where "rank" <= 3 group by 1),
      h as (select g.*, case when terms > 0 then found / terms else 0 end l, coalesce(s, 0) s from g left join sm using (query_id))
      select query_id, terms, found, files, round(l, 6) lexical, round(s, 6) semantic, case when l >= 0.25 or s >= 0.27 then 'answer' else 'refuse' end band from h""",
    "hybrid_search": f'with {SEARCH} select query_id, doc, "rank", round(bm25, 9) bm25, round(dense, 9) dense, round(structural, 9) structural, round(fused, 9) fused, round(cosine, 6) cosine from rt',
    "result_telemetry": f"""with {SEARCH}, p as (select query_id, path, min("rank") r from rt join cx using (doc) group by all), o as (select *, row_number() over (partition by query_id order by r) n from p),
      j as (select query_id, string_agg(path, '|' order by r) result_paths from o where n <= 12 group by 1), c as (select query_id, count(*)::int result_count from rt group by 1)
      select qs.query_id, coalesce(result_count, 0) result_count, coalesce(round(bm25, 9), 0) bm25, coalesce(round(dense, 9), 0) dense, coalesce(round(structural, 9), 0) structural, coalesce(result_paths, '') result_paths
      from qs left join c using (query_id) left join j using (query_id) left join (select * from rt where "rank" = 1) t using (query_id)""",
    "context_assembly": rf"""with {SEARCH}, p as (select query_id, "rank", '// ' || path || ':' || a || '-' || b || ' — ' || symbol || chr(10) || coalesce(code, '') part, symbol || ' (' || path || ':' || a || '-' || b || ')' label from rt join cx using (doc)),
      q as (select query_id, string_agg(label, '; ' order by "rank") citations, string_agg(part, chr(10) || chr(10) order by "rank") assembled from p group by 1)
      select *, ceil((length(assembled) + length(regexp_replace(assembled, '[^\x{{10000}}-\x{{10FFFF}}]', '', 'g'))) / 4)::bigint tokens from q""",
    "enforce_citations": r"""with d as (select doc_id as query_id, list_distinct(regexp_extract_all(regexp_replace(text, '\(([^()\s]+\.ts):[0-9-]+\)', '[\1]', 'g'), '\[([^\]]+)\]', 1)) m from documents),
      e as (select query_id, unnest(m) p from d), g as (select query_id, count(*) filter (p in (select path from source_files)) g, count(*) n from e group by 1)
      select query_id, coalesce(g, 0)::int known, coalesce(n - g, 0)::int unknown, coalesce(n > 0 and n = g, false) ok from d left join g using (query_id)""",
}
ORACLES["hybrid_gate"] = ORACLES["grounding_gate"]
