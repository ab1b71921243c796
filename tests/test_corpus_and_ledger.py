from __future__ import annotations

from datetime import datetime as T

from pyspark.sql import functions as F

from lodestone.operators import corpus, ledger
from lodestone.sources import chunker

ENTRY = "line_no long, arrived_at timestamp_ntz, query_id string, consumer string, query_text string, result_count int, band string, latency_ms double, answered boolean, tokens long, est_cost double"
OUTCOME = "line_no long, arrived_at timestamp_ntz, query_id string, answered boolean, tokens long, est_cost double"


def entry(line, hour, name, answered=None, tokens=None):
    return (line, T(2025, 1, 1, hour), name, "cli", "q", 1, "answer", 1.0, answered, tokens, None)


def test_outcomes_fill_the_last_entry_before_them(spark):
    entries = [entry(1, 1, "a"), entry(2, 2, "b"), entry(3, 5, "b", False, 7), entry(4, 6, None)]
    outcomes = [(1, T(2025, 1, 1, 3), "a", True, 10, 0.1), (2, T(2025, 1, 1, 4), "a", True, None, 0.2), (3, T(2025, 1, 1, 4), "b", True, 99, 9.9), (4, T(2025, 1, 1, 4), "orphan", True, 1, 1.0)]
    rows = ledger.reconciled(spark.createDataFrame(entries, ENTRY), spark.createDataFrame(outcomes, OUTCOME))
    got = {r.query_id: (r.answered, r.tokens, r.est_cost, r.first_line) for r in rows.collect()}
    assert got == {"a": (True, 10, 0.2, 1), "b": (False, 7, None, 2)}
    assert [r.query_id for r in ledger.newest(rows, 1).collect()] == ["b"]
    assert {r.layer: r.query_id for r in ledger.latest(rows).collect()} == {"retrieve": "b", "answer": "a"}
    empty = ledger.reconciled(spark.createDataFrame([], ENTRY), spark.createDataFrame(outcomes, OUTCOME))
    assert empty.count() == 0 and ledger.latest(empty).filter("query_id is not null").count() == 0


def test_walk_rules_in_order(spark):
    rows = [
        ("src/a.ts", 10, "x", None), ("src/a.d.ts", 2_000_000, "x", "declaration"), ("b.mts", 1_000_001, "x", "too-large"), ("c.cts", 1_000_000, "a\0b", "binary"),
        ("d.ts", 5, None, "read-error"), ("node_modules/e.ts", 5, "x", "left out"), ("f.js", 5, "x", "left out"), ("out", 5, "x", "left out"),
    ]
    files = spark.createDataFrame([(k, "r", p, s, c) for k, (p, s, c, _) in enumerate(rows)], "file_id long, repo string, path string, size_bytes long, code string")
    got = {r.file_id: r.reason for r in corpus.walked(files).collect()}
    assert got == {k: reason for k, (*_, reason) in enumerate(rows) if reason != "left out"}
    told = corpus.ingest_telemetry(corpus.walked(files)).first()
    assert told.walked == told.indexed + told.skipped + told.errors == 5


def test_changes(spark):
    kind = "repo string, path string, mtime_ms double, size_bytes long"
    before = spark.createDataFrame([("r", "a", 1.0, 1), ("r", "b", 1.0, 1), ("r", "c", 1.0, 1)], kind)
    now = spark.createDataFrame([("r", "a", 1.0, 1), ("r", "b", 1.0, 2), ("r", "d", 1.0, 1)], kind)
    assert {r.path: r.state for r in corpus.changes(before, now).collect()} == {"a": "unchanged", "b": "changed", "c": "deleted", "d": "new"}
    assert {r.state for r in corpus.changes(before.limit(0), now).collect()} == {"new"}


def test_completion_ranks_names_before_paths(spark):
    symbols = spark.createDataFrame([("loadRow", "x.ts"), ("reloadRow", "x.ts"), ("other", "src/load.ts"), ("none", None), (None, "load")], "symbol string, path string")
    asked = spark.createDataFrame([(1, "Load"), (2, "lo"), (3, None)], "query_id long, typed string")
    assert [(r.query_id, r.symbol) for r in corpus.complete(symbols, asked).orderBy("place").collect()] == [(1, "loadRow"), (1, "reloadRow"), (1, "other")]


SOURCE = """import { a, b as c } from './x'
import type Y from 'y'

export function greet(n: string): string { return a(n) }
const double = (x: number) => c(x)
const LIMIT = 3
// about LIMIT
export class Store extends Base {
  field = 1
  @Get('/users')
  load(id: number): void { this.field = new Map().get(id) }
  abstract later(): void
}
function sig(x: number): void
namespace N { export function inner() { return require('q') } }
export default () => import('./lazy')
"""


def test_chunks_of_a_file():
    got = {f"{s}@{a}-{b}": (kind, calls, imports) for s, kind, a, b, _, calls, imports in chunker.cut(SOURCE, "s.ts")}
    assert got == {
        "<module>@1-2": ("module", [], ["./x", "y"]), "greet@4-4": ("function", ["a"], ["./x"]), "double@5-5": ("function", ["c"], ["./x"]), "<module>@6-7": ("module", [], []),
        "Store@8-13": ("class", ["Get", "Map", "get"], []), "Store.load@10-11": ("method", ["Get", "Map", "get"], []), "<module>@14-14": ("module", [], []),
        "N@15-15": ("other", [], ["q"]), "N.inner@15-15": ("function", [], ["q"]), "default@16-16": ("function", [], ["./lazy"]),
    }


def test_chunks_of_other_and_broken_files(spark):
    assert [c[:4] for c in chunker.cut("a: 1\nb: 2\n", "x.yaml")] == [("<module>", "module", 1, 2)]
    assert [c[0] for c in chunker.cut("function f() {\n\nfunction g() { return 1 }\n) (\n", "x.ts")] == ["<module>", "g", "<module>"]
    assert chunker.cut(" \n", "x.ts") == [] and chunker.cut("", "x.py") == []
    files = spark.createDataFrame([("r", "a.ts", "f()", 1), ("r", "b.ts", None, 1), (None, None, "x", 1)], "repo string, path string, code string, span int")
    assert [r.id for r in chunker.chunked(files).collect()] == ["a.ts#<module>@1-1"]


def test_chunks_cover_every_symbol_of_the_table(spark):
    """The given chunks of hand-written TypeScript files hold the same symbols and code."""
    folder = "/root/testdata/sf0.001"
    files = spark.read.parquet(f"{folder}/source_files.parquet").filter("code is not null and path like 'src/%.ts'").dropDuplicates(["file_id"])
    given = spark.read.parquet(f"{folder}/chunks.parquet").filter("kind in ('function', 'class', 'method')").select("repo", "id", "code").distinct()
    own = chunker.chunked(files).select("repo", "id", F.col("code").alias("own"))
    both = given.join(files.select("repo", "path"), [given["repo"] == files["repo"], given["id"].startswith(files["path"])], "left_semi").join(own, ["repo", "id"], "left")
    assert both.count() > 20 and both.filter("own is null or rtrim(own) <> rtrim(code)").count() == 0
