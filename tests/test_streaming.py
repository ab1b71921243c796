from __future__ import annotations

from lodestone.operators import delivery
from lodestone.streaming import tail


def test_stream_accepts_each_message_once_over_batches(spark, tmp_path):
    kind = "line_no long, query_id string, ts long"
    for k, lines in enumerate([[(1, "p:q1", 1000), (2, "p:q2", 1000)], [(3, "P:Q2 ", 1500), (4, "p:q3", 1000), (5, "x", 1)], [(6, "X", 2), (7, "p:q1", 9000), (8, None, 1)]]):
        spark.createDataFrame(lines, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        rows = spark.readStream.schema(kind).parquet(str(tmp_path / "in"))
        tail.accepted_messages(delivery.keyed_lines(rows, "log", ts_col="ts"), str(tmp_path / "out"))
    take = lambda: sorted(r.line_no for r in spark.read.parquet(str(tmp_path / "out/accepted")).collect())
    assert take() == [1, 2, 4, 5, 7]
    last = spark.read.parquet(str(tmp_path / "out/ranges/2"))
    assert [(r.producer, r.lo, r.hi) for r in last.collect()] == [("p", 1, 3)]
    # the last batch dies after its files are written and before it is committed: it runs again and loses nothing
    for name in ("2", ".2.crc"):
        (tmp_path / f"out/state/commits/{name}").unlink(missing_ok=True)
    tail.accepted_messages(delivery.keyed_lines(spark.readStream.schema(kind).parquet(str(tmp_path / "in")), "log", ts_col="ts"), str(tmp_path / "out"))
    assert take() == [1, 2, 4, 5, 7]


def test_first_events_of_a_stream(spark, tmp_path):
    spark.sql("select id % 3 as k, timestamp_seconds(id) as t from range(20)").write.parquet(str(tmp_path / "in.parquet"))
    rows = tail.stream(spark, str(tmp_path), "in")
    assert sorted(r.k for r in tail.run_to_end(tail.first_seen(rows, ["k"], "t"), "first").collect()) == [0, 1, 2]
