"""Queries of the operators for training data, and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import credentials, generated, leakage, neighbours, subjects, syntax, tokenize
from lodestone.sources.tables import table


MODEL = "pebble-embed-2"


def _nearest(spark: SparkSession, d: str) -> DataFrame:
    """The ten nearest of every probe among all vectors of the current model."""
    vectors = neighbours.usable(table(spark, d, "chunk_vectors").filter(F.col("model_id") == MODEL), 64)
    probes = table(spark, d, "vector_probes").select(F.col("chunk_id").alias("id")).distinct()
    return neighbours.nearest(vectors.join(probes, "id", "left_semi"), vectors)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    near = _nearest(spark, d)
    return near.select(F.least("id", "other").alias("chunk_id_a"), F.greatest("id", "other").alias("chunk_id_b")).distinct()


def p1_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The ten nearest of every vector of the current model."""
    vectors = neighbours.usable(table(spark, d, "chunk_vectors").filter(F.col("model_id") == MODEL), 64)
    near = neighbours.nearest(vectors, vectors)
    return near.select(F.col("id").alias("chunk_id"), F.col("other").alias("neighbour_id"), F.round("similarity", 6).alias("similarity"), "place")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return syntax.judged(table(spark, d, "source_files")).filter("verdict not in ('valid', 'not parsed')").select("file_id").distinct()


def p4_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return syntax.judged(table(spark, d, "source_files"))


def p4_rates(spark: SparkSession, d: str) -> DataFrame:
    return syntax.invalid_rates(syntax.judged(table(spark, d, "source_files")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return credentials.credential_lines(table(spark, d, "chunks"))


def p5_redacted(spark: SparkSession, d: str) -> DataFrame:
    return credentials.redacted(table(spark, d, "chunks")).distinct()


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return generated.not_by_hand(table(spark, d, "source_files")).select("file_id")


def p6_scores(spark: SparkSession, d: str) -> DataFrame:
    return generated.scored(table(spark, d, "source_files")).withColumn("score", F.round("score", 6))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenize.encode(table(spark, d, "documents"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    found = leakage.leaked_passages(table(spark, d, "documents"), table(spark, d, "eval_items"), spans=False)
    return found.filter("kind = 'passage'").select("doc_id", "item_id").distinct()


def p8_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_passages(table(spark, d, "documents"), table(spark, d, "eval_items"))


def _subjects(spark: SparkSession, d: str) -> DataFrame:
    return subjects.assigned(*(table(spark, d, name) for name in ("documents", "subject_areas", "subject_labels", "repos")))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _subjects(spark, d)


def p9_composition(spark: SparkSession, d: str) -> DataFrame:
    return subjects.composition(_subjects(spark, d), table(spark, d, "documents"))


QUERIES = {"p1_found": p1_found, "p1_neighbours": p1_neighbours, "p4_found": p4_found, "p4_verdicts": p4_verdicts, "p4_rates": p4_rates, "p5_found": p5_found, "p5_redacted": p5_redacted, "p6_found": p6_found, "p6_scores": p6_scores, "p7_ids": p7_ids, "p8_found": p8_found, "p8_leaks": p8_leaks,
    "p9_found": p9_found, "p9_composition": p9_composition}
ORACLES = {
    "p1_found": """with v as (select distinct chunk_id, vector from chunk_vectors where model_id = 'pebble-embed-2' and len(vector) = 64
        and len(list_filter(vector, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(vector, lambda x: x <> 0)) > 0),
      s as (select q.chunk_id a, o.chunk_id b, max(list_cosine_similarity(q.vector::double[], o.vector::double[])) c
        from v q join (select distinct chunk_id from vector_probes) using (chunk_id) join v o on o.chunk_id <> q.chunk_id group by all),
      n as (select a, b from s qualify row_number() over (partition by a order by c desc, b) <= 10)
      select distinct least(a, b) chunk_id_a, greatest(a, b) chunk_id_b from n""",
}
