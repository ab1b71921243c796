"""Near misses: the symbol most like an identifier that the index lacks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text
from lodestone.sources.tables import broadcast_or_merge, checkpoint

LEAST, FARTHEST = 4, 0.34
_PIECE = ["n", "cuts", "piece", "part"]


def _most(length: Column) -> Column:
    """The most edits that a pair may have whose longer key is of this length."""
    return F.floor(length * FARTHEST + 1e-9).cast("int")


def _two_of_three(key: Column, n: Column) -> Column:
    """A key without one of the three pieces of a key of ``n`` signs, for each of the pieces: one edit spoils only one."""
    first, second, moved = F.expr("n div 3").cast("int"), F.expr("2 * n div 3").cast("int"), F.length(key) - n
    ends = [(second, n + moved), (first, second + moved), (F.lit(0), F.greatest(first + moved, F.lit(0)))]
    parts = [F.concat(F.substring(key, F.lit(1), head), F.substring(key, tail + 1, F.length(key))) for head, tail in ends]
    return F.inline(F.array(*[F.struct(F.lit(0).alias("cuts"), F.lit(k).alias("piece"), p.alias("part")) for k, p in enumerate(parts)]))


def _bounds(pieces: DataFrame) -> DataFrame:
    """``start, size`` of each piece of a key of ``n`` signs that is cut ``cuts`` times."""
    start = F.expr("piece * n div (cuts + 1)").cast("int")
    return pieces.withColumn("start", start).withColumn("size", F.expr("(piece + 1) * n div (cuts + 1)").cast("int") - F.col("start"))


def _stored(names: DataFrame, edits: int) -> DataFrame:
    """``b`` with the pieces of which a key within ``edits`` has one, by the number of cuts that the pair's longer key needs."""
    sized = names.withColumn("n", F.length("b"))
    if edits == 1:
        return sized.select("b", "n", _two_of_three(F.col("b"), F.col("n")))
    longest = F.floor(F.col("n") * FARTHEST / (1 - FARTHEST) + 1e-9).cast("int")  # cut by the edits from a longer key
    cut = sized.select("b", "n", F.explode(F.sequence(F.least(_most(F.col("n")), F.lit(edits)), F.least(longest, F.lit(edits)))).alias("cuts"))
    each = _bounds(cut.select("b", "n", "cuts", F.explode(F.sequence(F.lit(0), F.col("cuts"))).alias("piece")))
    return each.select("b", "n", "cuts", "piece", F.substring("b", F.col("start") + 1, F.col("size")).alias("part"))


def _wanted(keys: DataFrame, edits: int) -> DataFrame:
    """``a`` with the pieces, of keys of every length in reach, that a key within ``edits`` may have in common with it.

    Of a key with more pieces than edits there is a piece unharmed that has no more edits than
    pieces before it, and no more than pieces behind it; so it is moved by no more places.
    """
    length = F.length("a")
    sized = keys.select("a", F.explode(F.sequence(F.greatest(length - edits, F.lit(1)), length + edits)).alias("n"))
    if edits == 1:
        return sized.select("a", "n", _two_of_three(F.col("a"), F.col("n"))).distinct()
    moved = length - F.col("n")
    cut = sized.withColumn("cuts", F.least(_most(F.greatest(length, F.col("n"))), F.lit(edits))).filter(F.abs(moved) <= F.col("cuts"))
    each = _bounds(cut.select("a", "n", "cuts", F.explode(F.sequence(F.lit(0), F.col("cuts"))).alias("piece")))
    behind = F.col("cuts") - F.col("piece")
    low = F.greatest(F.lit(0), F.col("start") - F.col("piece"), F.col("start") + moved - behind)
    high = F.least(length - F.col("size"), F.col("start") + F.col("piece"), F.col("start") + moved + behind)
    places = each.withColumns({"low": low, "high": high}).filter("low <= high").withColumn("at", F.explode(F.sequence("low", "high")))
    return places.select("a", "n", "cuts", "piece", F.substring("a", F.col("at") + 1, F.col("size")).alias("part")).distinct()


def _nearest(keys: DataFrame, names: DataFrame) -> DataFrame:
    """``a, b, distance``: for each key ``a`` the names ``b`` at the least distance, which is at most 0.34.

    One edit is tried first, then twice as many as before, and only for keys that a name with more edits
    may still suit better: of a key of ``n`` signs, ``e`` edits lead to a distance of at least ``e / (n + e)``.
    """
    longer, length = F.greatest(F.length("a"), F.length("b")), F.length("a")
    done, edits = [], 1
    while True:
        pairs = _stored(names, edits).join(broadcast_or_merge(checkpoint(_wanted(keys, edits))), _PIECE).select("a", "b")
        close = pairs.withColumn("edits", F.levenshtein("a", "b", edits)).filter("edits >= 0").select("a", "b", (F.col("edits") / longer).alias("distance")).filter(F.col("distance") <= FARTHEST)
        least = close.groupBy("a").agg(F.min(F.round("distance", 9)).alias("least"))
        close = checkpoint(close.join(least, "a").filter(F.round("distance", 9) == F.col("least")).distinct())
        further = F.lit(edits + 1) / (length + edits + 1)
        open_keys = keys.join(close.select("a", "least").distinct(), "a", "left")
        keys = checkpoint(open_keys.filter((further <= FARTHEST + 1e-9) & (F.col("least").isNull() | (F.col("least") >= F.round(further, 9)))).select("a"))
        done.append(close.join(keys, "a", "left_anti").select("a", "b", "distance"))
        if keys.isEmpty():
            return reduce(DataFrame.unionByName, done)
        edits *= 2


def nearest_symbols(queries: DataFrame, symbols: DataFrame) -> DataFrame:
    """``query_id, symbol, distance``: for queries whose identifiers are all unknown, the nearest symbol within 0.34.

    The distance is the edit distance of the keys over the longer key's length. Ties: the shorter
    symbol, then the smaller one.
    """
    known = symbols.filter(F.length("symbol") >= LEAST).select("symbol").distinct()
    asked = queries.select("query_id", F.explode(text.query_identifiers(F.col("query_text"))).alias("ident"))
    found = asked.withColumn("low", F.lower("ident")).join(known.select(F.lower("symbol").alias("low")).distinct().hint("merge"), "low", "left_semi").select("query_id").distinct()
    open_idents = asked.join(found, "query_id", "left_anti").select("query_id", text.identifier_key(F.col("ident")).alias("a")).filter("a <> ''").distinct()
    keyed = known.select("symbol", text.identifier_key(F.col("symbol")).alias("b")).filter("b <> ''")
    close = _nearest(checkpoint(open_idents.select("a").distinct()), checkpoint(keyed.select("b").distinct()))
    pairs = open_idents.join(broadcast_or_merge(checkpoint(close)), "a").join(keyed.hint("merge"), "b")
    best = pairs.groupBy("query_id").agg(F.min(F.struct(F.round("distance", 9).alias("distance"), F.length("symbol").alias("n"), "symbol")).alias("m"))
    return best.select("query_id", "m.symbol", F.round("m.distance", 6).alias("distance"))
