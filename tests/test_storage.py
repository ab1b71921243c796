from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lodestone.functions import embedding
from lodestone.operators import dialogue
from lodestone.sources import jsonl, repository
from lodestone.sources.store import Store, synced
from lodestone.sources.tables import broadcast_if_small, checkpoint, fits


def test_vectors_to_bytes_and_back(spark):
    rows = spark.createDataFrame([(1, [1.5, -2.0]), (2, []), (3, None)], "id long, v array<float>").withColumn("b", embedding.encoded("v"))
    assert [r.b for r in rows.orderBy("id").collect()] == [b"\x00\x00\xc0\x3f\x00\x00\x00\xc0", b"", None]
    assert [r.x for r in rows.orderBy("id").select(embedding.decoded("b").alias("x")).collect()] == [[1.5, -2.0], [], None]
    assert spark.sql("select X'010203' as b").select(embedding.decoded("b").alias("x")).first().x is None


def test_hashed_vectors(spark):
    rows = spark.createDataFrame([(1, "loadToken x"), (2, "x load token"), (3, ""), (4, None)], "id long, t string")
    got = {r.id: r.vector for r in embedding.hashed(rows, F.col("t"), 16).collect()}
    assert sum(x * x for x in got[1]) == pytest.approx(1) and not any(got[3]) and not any(got[4]) and got[1] != got[2]


def test_ledger_lines(spark, tmp_path):
    at = str(tmp_path / "ledger")
    jsonl.append(spark.createDataFrame([("a", 1.0, None)], "queryId string, ts double, answered boolean"), at)
    jsonl.append(spark.createDataFrame([("a", True)], "queryId string, answered boolean"), at)
    (tmp_path / "ledger/part-9.json").write_text('\n{"queryId": "b", "ts": 5\nnot json\n{"queryId": "c"}\n[1]\n{"queryId": "d", "ts": 7, "other": {}}\n')
    assert sorted((r.kind, r.queryId) for r in jsonl.scan(spark, at).collect()) == [("entry", "a"), ("entry", "d"), ("outcome", "a")]
    jsonl.clear(spark, at)
    assert jsonl.scan(spark, at).count() == 0


def test_store_replaces_whole_versions(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    assert store.current() is None
    with pytest.raises(FileNotFoundError):
        store.read("t")
    first = store.replace({"t": spark.range(3)})
    with pytest.raises(Exception):
        store.replace({"t": spark.range(5), "bad": spark.range(1).select(F.raise_error(F.lit("stop")))})
    assert store.current() == first and store.read("t").count() == 3
    store.replace({"t": spark.range(4)})
    assert store.current() != first and store.read("t").count() == 4


def test_sync_embeds_only_what_changed(spark, tmp_path):
    kind = "seq long, repo string, path string, symbol string, code string"
    one = spark.createDataFrame([(1, "r", "a", "f", "x"), (2, "r", "b", "g", "x")], kind)
    two = spark.createDataFrame([(1, "r", "a", "f", "x"), (3, "r", "b", "g2", "x"), (4, "r", "c", "h", "x")], kind)
    changes = spark.createDataFrame([("r", "a", "unchanged"), ("r", "b", "changed"), ("r", "c", "new")], "repo string, path string, state string")
    store, embed = Store(spark, str(tmp_path)), lambda rows: embedding.hashed(rows, F.col("symbol"), 8)
    synced(store, one, changes, embed, "m")
    synced(store, two, changes, embed, "m")
    assert {(r.seq, r.reused) for r in store.read("vectors").collect()} == {(1, True), (3, False), (4, False)}
    synced(store, two, changes, embed, "other")
    assert {r.reused for r in store.read("vectors").collect()} == {False}


def test_walk_of_a_folder(spark, tmp_path):
    for name, data in {"src/a.ts": b"let a = 1", "src/b.js": b"x", "node_modules/c.ts": b"x", "d.mts": b"\xff\xfe", "deep/er/e.cts": b"f()"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    (tmp_path / "away").mkdir()
    (tmp_path / "away/f.js").write_bytes(b"x")
    (tmp_path / "linked.ts").symlink_to(tmp_path / "src/a.ts")
    (tmp_path / "loop").symlink_to(tmp_path / "deep")
    got = {r.path: (r.size_bytes, r.code) for r in repository.files(spark, str(tmp_path), "r").collect()}
    assert got == {"src/a.ts": (9, "let a = 1"), "d.mts": (2, None), "deep/er/e.cts": (3, "f()")}


def test_recent_turns(spark):
    turns = spark.createDataFrame([(1, k, "assistant" if k % 2 else "user") for k in range(9)] + [(2, 1, "assistant")], "conv_id long, turn long, role string")
    assert sorted((r.conv_id, r.turn) for r in dialogue.recent(turns).collect()) == [(1, k) for k in range(4, 9)]
    asked = spark.createDataFrame([("what does it do", 1), ("what does it do", 0), ("what does loadRow do with it", 1), (" ", 1), ("list files", 1), (None, 1)], "q string, n int")
    assert [r.x for r in asked.select(dialogue.needs_rewrite(F.col("q"), F.col("n")).alias("x")).collect()] == [True, False, False, False, False, False]


def test_sizes_are_checked_before_broadcast(spark):
    assert fits(spark.range(10)) and not fits(spark.range(10), 8)
    assert "broadcast" not in broadcast_if_small(spark.range(10), 8)._jdf.queryExecution().logical().toString().lower()
    assert checkpoint(spark.range(5)).count() == 5
