from __future__ import annotations

from datetime import datetime as T

from pyspark.sql import functions as F

from lodestone.operators import references as R

CHUNK = "seq long, repo string, path string, structural_refs struct<calls:array<string>,imports:array<string>>, indexed_at timestamp_ntz, name string, kind string"
SYMBOL = "repo string, symbol string, first_seen timestamp_ntz, deleted_at timestamp_ntz, at int"
FILE = "repo string, path string, added_at timestamp_ntz, deleted_at timestamp_ntz"


def day(n):
    return T(2025, 1, n)


def orphans(spark, chunks, symbols=(), files=(), externals=("map",)):
    events = R.parent_events(spark.createDataFrame(list(symbols), SYMBOL), spark.createDataFrame(list(files), FILE))
    refs = R.chunk_references(spark.createDataFrame(list(chunks), CHUNK))
    known = spark.createDataFrame([(x,) for x in externals], "callee string")
    return {(r.seq, r.ref_kind, r.ref_value) for r in R.orphan_references(refs, events, known).collect()}


def chunk(seq, at, calls=(), imports=(), repo="r", path="src/a/b.ts"):
    return (seq, repo, path, (list(calls), list(imports)), at, "x", "y")


def test_lifetimes_decide_at_the_time_of_the_reference(spark):
    symbols = [("r", "f", day(2), day(5), 1), ("r", "f", day(9), None, 1), ("r", "f", day(2), day(5), 1)]
    chunks = [chunk(n, day(n), ["f", "map", None, "f"]) for n in (1, 2, 4, 5, 8, 9, 30)]
    assert orphans(spark, chunks, symbols) == {(1, "calls", "f"), (5, "calls", "f"), (8, "calls", "f")}


def test_short_names_count_only_if_no_entry_ever_bears_the_whole_name(spark):
    symbols = [("r", "A.load", day(1), None, 1), ("r", "B.save", day(1), None, 1), ("r", "save", day(20), day(21), 1), ("q", "gone", day(1), None, 1)]
    assert orphans(spark, [chunk(1, day(5), ["load", "save", "gone", "A.load", ""])], symbols) == {(1, "calls", "save"), (1, "calls", "gone"), (1, "calls", "")}


def test_imports_lead_to_files_without_their_endings(spark):
    files = [("r", "src/x.mts", day(1), None), ("r", "src/a/y.js", day(1), day(3)), ("r", "top", day(1), None), ("s", "src/z.ts", day(1), None)]
    chunks = [chunk(1, day(4), [], ["../x.js", "./y", ".././a/..//x", "../../../top.tsx", "bare", "../z"])]
    assert orphans(spark, chunks, (), files) == {(1, "imports", "./y"), (1, "imports", "../z")}


def test_nulls_and_empty_tables(spark):
    chunks = [(1, None, None, (["f"], ["./g"]), None, "x", "y"), (2, "r", "p.ts", None, day(1), "x", "y"), (3, "r", "p.ts", (None, None), day(1), "x", "y")]
    symbols = [(None, "f", day(1), None, 1), ("r", None, day(1), None, 1), ("r", "f", None, None, 1)]
    assert orphans(spark, chunks, symbols) == {(1, "calls", "f"), (1, "imports", "./g")}
    assert orphans(spark, []) == set()


def test_stored_text_that_is_no_object_holds_nothing(spark):
    texts = ['{"calls":["a", 3],"imports":["./b"]}', '{"calls":["a"]', "[1]", "", None, '{"imports": []}', '{"calls": null}', "null"]
    rows = spark.createDataFrame([(k, "r", "p.ts", t, day(1)) for k, t in enumerate(texts)], "row_seq long, repo string, path string, structural_refs string, stored_at timestamp_ntz")
    got = {(r.seq, r.ref_value) for r in R.chunk_references(rows, "chunk_rows", "row_seq", "stored_at").collect()}
    assert (0, "a") in got and (0, "./b") in got and {s for s, _ in got} == {0}


def test_waiting_references_are_resolved_and_reopened(spark):
    events = R.parent_events(spark.createDataFrame([("r", "f", T(2025, 2, 3), T(2025, 4, 2), 1)], SYMBOL), spark.createDataFrame([], FILE))
    refs = R.chunk_references(spark.createDataFrame([chunk(1, T(2025, 1, 5), ["f"]), chunk(2, T(2025, 3, 5), ["f"])], CHUNK))
    waiting = R.pending_by_period(refs, events, spark.createDataFrame([], "callee string")).filter("src_table = 'chunks'").orderBy("period")
    assert [r.waiting for r in waiting.collect()] == [1, 0, 0, 2]


def test_batches_give_what_one_batch_gives(spark):
    """State goes in and out: a parent that arrives later resolves what waits, its deletion reopens it."""
    symbols = spark.createDataFrame([("r", "f", day(5), day(20), 1), ("r", "A.g", day(3), None, 1), ("r", "h", day(9), None, 1), ("r", "B.h", day(1), None, 1)], SYMBOL)
    events, none = R.parent_events(symbols, spark.createDataFrame([], FILE)), spark.createDataFrame([], "callee string")
    refs = R.chunk_references(spark.createDataFrame([chunk(n, day(n), ["f", "g", "h"]) for n in (2, 4, 8, 12, 22)], CHUNK))
    take = lambda df: sorted(tuple(r) for r in df.collect())
    one, last = R.folded(refs, events, none, 1)
    many, state = R.folded(refs, events, none, 4)
    assert take(one) == take(many) and take(last.waiting()) == take(state.waiting())
    first = R.State(R.names(events), R.empty_state(spark).held)
    early = F.col("at") < F.lit(day(4)).cast("timestamp_ntz")
    found, then = R.step(first, refs.filter(early), events.filter(early))
    assert {r.ref_value for r in found.collect()} == {"f", "g", "h"} and [r.waiting for r in then.waiting().collect()] == [2]  # g has come since
    later = ~early & (F.col("at") < F.lit(day(10)).cast("timestamp_ntz"))
    found, then = R.step(then, refs.filter(later), events.filter(later))
    assert {(r.seq, r.ref_value) for r in found.collect()} == {(4, "f"), (4, "h"), (8, "h")} and then.waiting().count() == 0
    end = F.col("at") >= F.lit(day(10)).cast("timestamp_ntz")
    found, then = R.step(then, refs.filter(end), events.filter(end))
    assert {(r.seq, r.ref_value) for r in found.collect()} == {(22, "f")} and [r.waiting for r in then.waiting().collect()] == [5]  # all calls of f are open again


def test_every_period_is_reported(spark):
    events = R.parent_events(spark.createDataFrame([("r", "f", T(2025, 6, 3), None, 1)], SYMBOL), spark.createDataFrame([], FILE))
    refs = R.chunk_references(spark.createDataFrame([chunk(1, T(2025, 1, 5), ["f"])], CHUNK), "other_table")
    waiting = R.pending_by_period(refs, events, spark.createDataFrame([], "callee string")).orderBy("period")
    assert [(r.src_table, r.waiting) for r in waiting.collect()] == [("other_table", n) for n in (1, 1, 1, 1, 1, 0)]


def test_path_columns(spark):
    got = spark.range(1).select(R.resolve_path(F.lit("a/b.ts"), F.lit("./c/../d.cjs")).alias("p"), R.file_key(F.lit("./x//y/../z.tsx")).alias("q")).first()
    assert (got.p, got.q) == ("a/d", "x/z")
