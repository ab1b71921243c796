"""References to records that do not exist: orphan state over time.

Parents (symbol entries, source files) come and go; references arrive with their own time.
A key ``(kind, repo, name)`` is alive at a time if the sum of its parents' arrivals (+1) and
deletions (-1) up to that time is positive. A reference is an orphan while its key is not
alive: a new reference probes the parents, an arriving parent resolves the waiting
references, a deletion reopens them.

The state between batches is two keyed frames (:class:`State`): the live parents of each key, and how
many references of each table hang on it, which wait while the key is not alive. A batch probes the
state with its references, replays its own arrivals and deletions, and hands on the next state.

Within a batch there is one snapshot per key and minute (live parents at its start), and the events of
a minute are replayed in order. No task ever holds more than one minute of one key, so a hot repository
or method name is spread over time, and parents and references are pre-aggregated per key and time
before they are shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.sources.tables import checkpoint

PERIOD, EPOCHS = "minute", 2
#: Fixed value: the time of what has none.
_NEVER = "timestamp_ntz '1900-01-01'"
KEY = ["kind", "repo", "name"]
#: The endings that an import may leave off.
ENDINGS = r"\.(ts|tsx|js|jsx|mts|cts|mjs|cjs)$"
_REFS = "struct<calls:array<string>,imports:array<string>>"


def resolve_path(row_path: Column, spec: Column) -> Column:
    """The path a relative import leads to, without its ending.

    ``.``, ``..`` and empty segments are collapsed; ``..`` above the root is dropped. A null
    path counts as the root.
    """
    folder = F.regexp_replace(F.coalesce(row_path, F.lit("")), r"[^/]*$", "")
    parts = F.split(F.concat(folder, spec), "/")
    walked = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda done, part: F.when(part.isin("", "."), done)
        .when(part == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))))
        .otherwise(F.concat(done, F.array(part))),
    )
    return F.regexp_replace(F.array_join(walked, "/"), ENDINGS, "")


def file_key(path: Column) -> Column:
    """A file's path as imports name it: segments collapsed, ending left off."""
    return resolve_path(F.lit(""), path)


def chunk_references(chunks: DataFrame, table: str = "chunks", seq: str = "seq", at: str = "indexed_at") -> DataFrame:
    """``src_table, seq, ref_kind, ref_value, kind, repo, name, at`` of every reference of a chunk table.

    ``structural_refs`` is a struct of arrays, or JSON text; text that is no JSON object, null
    structs, arrays and elements hold no references. Calls give their name as key, relative
    imports the file they lead to; other imports are no references here.
    """
    refs = F.col("structural_refs")
    if dict(chunks.dtypes)["structural_refs"] == "string":
        whole = F.when(F.col("structural_refs").rlike(r"(?s)^\s*\{.*\}\s*$"), F.try_parse_json("structural_refs"))
        refs = F.struct(
            F.try_variant_get(whole, "$.calls", "array<string>").alias("calls"),
            F.try_variant_get(whole, "$.imports", "array<string>").alias("imports"),
        )
    rows = chunks.select(F.lit(table).alias("src_table"), F.col(seq).cast("long").alias("seq"), "repo", "path", F.col(at).alias("at"), refs.cast(_REFS).alias("refs"))
    named = rows.select(
        "src_table", "seq", "repo", "path", "at",
        F.explode(F.map_from_arrays(F.array(F.lit("calls"), F.lit("imports")), F.array("refs.calls", "refs.imports"))).alias("ref_kind", "values"),
    )
    each = named.select("src_table", "seq", "repo", "path", "at", "ref_kind", F.explode(F.array_distinct("values")).alias("ref_value"))
    each = each.filter("ref_value is not null and (ref_kind = 'calls' or startswith(ref_value, '.'))")
    return each.select(
        "src_table", "seq", "ref_kind", "ref_value",
        F.col("ref_kind").alias("kind"), "repo",
        F.when(F.col("ref_kind") == "calls", F.col("ref_value")).otherwise(resolve_path(F.col("path"), F.col("ref_value"))).alias("name"),
        F.coalesce(F.col("at"), F.expr(_NEVER)).alias("at"),
    )


def parent_events(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """``kind, repo, name, at, exact, short, ever`` -- summed arrivals and deletions per key and time.

    A symbol ``A.b`` counts as ``exact`` under its whole name and as ``short`` under ``b``.
    ``ever`` tells that a key names some entry exactly, whenever that was. A parent that never
    began, or was deleted no later than it began, is never there but still counts for ``ever``.
    """
    dotted = F.col("symbol").contains(".")
    symbol = symbols.filter("repo is not null and symbol is not null").select(
        F.lit("calls").alias("kind"), "repo", F.col("first_seen").alias("began"), F.col("deleted_at").alias("ended"),
        F.explode(
            F.when(dotted, F.array(F.struct(F.col("symbol").alias("name"), F.lit(True).alias("whole")), F.struct(F.substring_index("symbol", ".", -1).alias("name"), F.lit(False).alias("whole"))))
            .otherwise(F.array(F.struct(F.col("symbol").alias("name"), F.lit(True).alias("whole"))))
        ).alias("as"),
    ).select("kind", "repo", "as.name", "as.whole", "began", "ended")
    file = files.filter("repo is not null and path is not null").select(
        F.lit("imports").alias("kind"), "repo", file_key(F.col("path")).alias("name"), F.lit(True).alias("whole"), F.col("added_at").alias("began"), F.col("deleted_at").alias("ended")
    )
    lives = symbol.unionByName(file)
    there = F.expr("began is not null and (ended is null or ended > began)")
    step = lambda column, sign: F.struct(F.col(column).alias("at"), F.when(there & F.col(column).isNotNull(), F.lit(sign)).otherwise(0).alias("delta"))
    moves = lives.select(*KEY, "whole", F.explode(F.when(F.col("ended").isNull(), F.array(step("began", 1))).otherwise(F.array(step("began", 1), step("ended", -1)))).alias("move"))
    moves = moves.select(*KEY, "whole", "move.delta", F.coalesce("move.at", F.expr(_NEVER)).alias("at"))
    return moves.groupBy(*KEY, "at").agg(
        F.sum(F.when(F.col("whole"), F.col("delta")).otherwise(0)).alias("exact"),
        F.sum(F.when(F.col("whole"), 0).otherwise(F.col("delta"))).alias("short"),
        F.max("whole").alias("ever"),
    )


def _live(events: DataFrame, probes: DataFrame, period: str) -> DataFrame:
    """``kind, repo, name, at, alive`` for each probe (key and time)."""
    both = (
        events.withColumn("refs", F.lit(0).cast("long"))
        .unionByName(probes.select(*KEY, "at", F.lit(0).cast("long").alias("exact"), F.lit(0).cast("long").alias("short"), F.lit(False).alias("ever"), F.col("refs")))
        .withColumn("period", F.date_trunc(period, "at"))
    )
    both = both.repartition(*KEY, "period")
    snapshot = both.groupBy(*KEY, "period").agg(F.sum("exact").alias("exact"), F.sum("short").alias("short"), F.max("ever").alias("ever"))
    of_key = Window.partitionBy(*KEY)
    before = of_key.orderBy("period").rowsBetween(Window.unboundedPreceding, -1)
    snapshot = snapshot.select(
        *KEY, "period",
        F.coalesce(F.sum("exact").over(before), F.lit(0)).alias("exact_before"),
        F.coalesce(F.sum("short").over(before), F.lit(0)).alias("short_before"),
        F.max("ever").over(of_key).alias("named"),
    )
    same = [F.col(f"e.{k}").eqNullSafe(F.col(f"s.{k}")) for k in [*KEY, "period"]]
    so_far = Window.partitionBy(*KEY, "period").orderBy("at").rangeBetween(Window.unboundedPreceding, 0)
    replayed = both.select(*KEY, "period", "at", "refs", F.sum("exact").over(so_far).alias("exact"), F.sum("short").over(so_far).alias("short")).filter("refs > 0")
    joined = replayed.alias("e").join(snapshot.alias("s"), same)
    alive = F.when(F.col("s.named"), F.col("e.exact") + F.col("s.exact_before")).otherwise(F.col("e.short") + F.col("s.short_before")) > 0
    return joined.select(*[f"e.{k}" for k in KEY], "e.at", alive.alias("alive"))


@dataclass(frozen=True)
class State:
    """What a batch leaves to the next.

    ``parents``: kind, repo, name, exact, short, ever -- live parents of each key, and whether some entry
    bears it exactly, whenever. ``held``: kind, repo, name, src_table, refs -- references on each key.
    """

    parents: DataFrame
    held: DataFrame

    def waiting(self) -> DataFrame:
        """``src_table, ref_kind, waiting``: the references whose key is not alive."""
        same = [F.col(f"h.{k}").eqNullSafe(F.col(f"p.{k}")) for k in KEY]
        alive = F.when(F.col("p.ever"), F.col("p.exact")).otherwise(F.coalesce("p.short", F.lit(0))) > 0
        open_refs = self.held.alias("h").join(self.parents.alias("p"), same, "left").filter(~alive)
        return open_refs.groupBy("h.src_table", F.col("h.kind").alias("ref_kind")).agg(F.sum("h.refs").alias("waiting"))


def empty_state(spark: SparkSession) -> State:
    key = "kind string, repo string, name string"
    return State(spark.createDataFrame([], f"{key}, exact long, short long, ever boolean"), spark.createDataFrame([], f"{key}, src_table string, refs long"))


def open_references(references: DataFrame, externals: DataFrame) -> DataFrame:
    """The references that no external name resolves."""
    known = externals.select(F.lit("calls").alias("kind"), F.col("callee").alias("name")).filter("name is not null").distinct()
    return references.join(known, ["kind", "name"], "left_anti")


def names(events: DataFrame) -> DataFrame:
    """A state's ``parents`` that knows which names are borne exactly by some entry, and of no live one yet."""
    none = F.lit(0).cast("long")
    return events.filter("ever").select(*KEY).distinct().select(*KEY, none.alias("exact"), none.alias("short"), F.lit(True).alias("ever"))


def step(state: State, references: DataFrame, events: DataFrame, period: str = PERIOD) -> tuple[DataFrame, State]:
    """One batch: the references that are orphans when they arrive, and the state after the batch.

    ``references`` (of :func:`open_references`) and ``events`` (of :func:`parent_events`) are the batch's own and
    none of them is older than the state; batches in order of time give what one batch of all gives.
    """
    before = state.parents.withColumn("at", F.expr(_NEVER)).select(*KEY, "at", "exact", "short", "ever")
    probes = references.groupBy(*KEY, "at").agg(F.count(F.lit(1)).alias("refs"))
    dead = _live(before.unionByName(events), probes, period).filter("not alive")
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"d.{k}")) for k in [*KEY, "at"]]
    orphans = references.alias("r").join(dead.alias("d"), same, "left_semi").select("src_table", "seq", "ref_kind", "ref_value", "at").distinct()
    moved = state.parents.unionByName(events.drop("at")).groupBy(*KEY).agg(F.sum("exact").alias("exact"), F.sum("short").alias("short"), F.max("ever").alias("ever"))
    arrived = references.groupBy(*KEY, "src_table").agg(F.count(F.lit(1)).alias("refs"))
    return orphans, State(moved, state.held.unionByName(arrived).groupBy(*KEY, "src_table").agg(F.sum("refs").alias("refs")))


def folded(references: DataFrame, events: DataFrame, externals: DataFrame, epochs: int = EPOCHS, period: str = PERIOD) -> tuple[DataFrame, State]:
    """All orphans and the last state of a whole history, folded in ``epochs`` stretches of time."""
    spark = references.sparkSession
    refs, moves = checkpoint(open_references(references, externals)), checkpoint(events)
    first, last = refs.filter(F.col("at") > F.expr(_NEVER)).agg(F.min("at"), F.max("at")).first()
    borders = [first + (last - first) * k / epochs for k in range(1, epochs)] if first else []
    state, found = State(names(moves), empty_state(spark).held), []
    for a, b in zip([None, *borders], [*borders, None]):
        within = reduce(Column.__and__, [F.lit(True), *([F.col("at") >= F.lit(a).cast("timestamp_ntz")] if a else []), *([F.col("at") < F.lit(b).cast("timestamp_ntz")] if b else [])])
        orphans, after = step(state, refs.filter(within), moves.filter(within), period)
        found.append(orphans)
        state = State(checkpoint(after.parents), checkpoint(after.held)) if b else after
    return reduce(DataFrame.unionByName, found), state


def orphan_references(references: DataFrame, events: DataFrame, externals: DataFrame, epochs: int = EPOCHS, period: str = PERIOD) -> DataFrame:
    """The references of :func:`chunk_references` whose target is not there at the reference's time.

    ``externals`` (callee) are names that always resolve. Of a name that some entry of the
    repository bears exactly, only such entries count; of any other name the entries whose last
    part it is. A reference with a null repository has no parent; one without a time precedes
    every parent. Rows come out once each: src_table, seq, ref_kind, ref_value, at.
    """
    return folded(references, events, externals, epochs, period)[0]


def orphan_counts(orphans: DataFrame, period: str = "month") -> DataFrame:
    """``src_table, period, ref_kind, orphans`` -- orphans per table and period of the reference."""
    return orphans.groupBy("src_table", F.date_trunc(period, "at").alias("period"), "ref_kind").agg(F.count(F.lit(1)).alias("orphans"))


def pending_by_period(references: DataFrame, events: DataFrame, externals: DataFrame, period: str = "month") -> DataFrame:
    """``src_table, ref_kind, period, waiting`` -- how many references wait for a parent at each period's end.

    The state of a key after a period is its references so far and its live parents; it is
    carried from period to period, so parents that arrive later resolve waiting references and
    deletions reopen resolved ones. Every period from the first event or reference on is reported.
    """
    first = F.min(F.when(F.col("at") > F.expr(_NEVER), F.col("at")))
    least, most = events.select("at").unionByName(references.select("at")).agg(F.date_trunc(period, first), F.date_trunc(period, F.max("at"))).first()
    early = lambda df: df.withColumn("period", F.greatest(F.date_trunc(period, "at"), F.lit(least).cast("timestamp_ntz")))
    refs = early(open_references(references, externals))
    arrived = refs.groupBy(*KEY, "period", "src_table").agg(F.count(F.lit(1)).alias("refs"))
    moved = early(events).groupBy(*KEY, "period").agg(F.sum("exact").alias("exact"), F.sum("short").alias("short"), F.max("ever").alias("ever"))
    state = moved.withColumn("refs", F.create_map().cast("map<string,bigint>")).unionByName(
        arrived.groupBy(*KEY, "period").agg(F.map_from_entries(F.collect_list(F.struct("src_table", "refs"))).alias("refs"), F.lit(0).cast("long").alias("exact"), F.lit(0).cast("long").alias("short"), F.lit(False).alias("ever"))
    )
    tables = sorted(r[0] for r in refs.select("src_table").distinct().collect())  # the names of the tables, a handful
    if not tables:
        return references.sparkSession.createDataFrame([], "ref_kind string, period timestamp_ntz, src_table string, waiting long")
    state = state.groupBy(*KEY, "period").agg(*[F.sum(F.coalesce(F.col("refs")[t], F.lit(0))).alias(t) for t in tables], F.sum("exact").alias("exact"), F.sum("short").alias("short"), F.max("ever").alias("ever"))
    of_key = Window.partitionBy(*KEY)
    so_far = of_key.orderBy("period").rowsBetween(Window.unboundedPreceding, 0)
    alive = F.when(F.max("ever").over(of_key), F.sum("exact").over(so_far)).otherwise(F.sum("short").over(so_far)) > 0
    held = state.select(*KEY, "period", F.lead("period").over(of_key.orderBy("period")).alias("until"), *[F.when(alive, 0).otherwise(F.sum(t).over(so_far)).alias(t) for t in tables])
    # a state holds until the key's next event: it enters the total at its period and leaves it at the next one
    enter = held.select("kind", "period", *tables).unionByName(held.filter("until is not null").select("kind", F.col("until").alias("period"), *[(-F.col(t)).alias(t) for t in tables]))
    change = enter.groupBy("kind", "period").agg(*[F.sum(t).alias(t) for t in tables])
    run = Window.partitionBy("kind").orderBy("period").rowsBetween(Window.unboundedPreceding, 0)
    every = references.sparkSession.range(1).select(F.explode(F.sequence(F.lit(least).cast("timestamp_ntz"), F.lit(most).cast("timestamp_ntz"), F.expr(f"interval 1 {period}"))).alias("period"))
    whole = change.select("kind").distinct().crossJoin(F.broadcast(every)).join(change, ["kind", "period"], "left").na.fill(0, tables)  # two kinds by the periods
    total = whole.select(F.col("kind").alias("ref_kind"), "period", *[F.sum(t).over(run).alias(t) for t in tables])
    return total.select("ref_kind", "period", F.explode(F.create_map(*[x for t in tables for x in (F.lit(t), F.col(t))])).alias("src_table", "waiting"))
