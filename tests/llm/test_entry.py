"""The registered queries of the subpackage on the smallest tables."""

from __future__ import annotations

import pytest
from helpers import against_sql

from lodestone.llm import entry

SMALL = "/root/testdata/sf0.001"
KINDS = {
    "p1_found": "chunk_id_a string, chunk_id_b string", "p4_found": "file_id bigint", "p5_found": "seq bigint, line_no int", "p6_found": "file_id bigint",
    "p7_ids": "doc_id bigint, ids array<int>", "p8_found": "doc_id bigint, item_id bigint", "p9_found": "doc_id bigint, subject string",
}


@pytest.mark.parametrize("name", sorted(entry.QUERIES))
def test_query_gives_distinct_rows_of_its_columns(spark, name):
    df = entry.QUERIES[name](spark, SMALL)
    rows = [str(r) for r in df.collect()]
    assert rows and len(set(rows)) == len(rows) and len(set(df.columns)) == len(df.columns)
    assert ", ".join(f"{c} {kind}" for c, kind in df.dtypes) == KINDS.get(name, ", ".join(f"{c} {kind}" for c, kind in df.dtypes))


@pytest.mark.parametrize("name", sorted(entry.ORACLES))
def test_query_equals_sql(spark, name):
    against_sql(spark, entry.QUERIES[name], entry.ORACLES[name])


def test_one_row_of_ids_for_each_document(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    ids = entry.QUERIES["p7_ids"](spark, SMALL)
    assert ids.count() == docs.count() and ids.filter("ids is null").count() == 0


def test_redaction_leaves_no_credential(spark):
    from lodestone.llm import credentials

    clean = entry.QUERIES["p5_redacted"](spark, SMALL).join(spark.read.parquet(f"{SMALL}/chunks.parquet").select("seq", "path").distinct(), "seq")
    assert clean.filter("credentials > 0").count() > 0 and credentials.credential_lines(clean).count() == 0
