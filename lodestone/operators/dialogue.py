"""Conversations: recent turns, and questions that lean on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEPT = 6
_LEFT, _RIGHT = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
#: Forms that point back to earlier turns, and forms that name their own subject.
_POINTING = (
    rf"(?i)^(?:and|but|or|so|then|also|plus){_RIGHT}|^(?:what|how)\s+about{_RIGHT}|{_LEFT}(?:it|its|they|them|those|these){_RIGHT}"
    rf"|{_LEFT}(?:this|that)\s+(?:one|function|class|method|file|code|module|thing|part|error|test|change|approach|logic){_RIGHT}"
)
_CONCRETE = (
    rf"[a-z][a-zA-Z0-9]*[A-Z]|[a-z0-9]+_[a-z0-9]+|`[^`]+`|{_LEFT}[A-Za-z0-9_]+\(\)|{_LEFT}[A-Za-z0-9_/.-]+\.(?:ts|mts|cts|tsx|js|jsx){_RIGHT}"
    rf"|{_LEFT}[A-Z][a-z]+[A-Z][a-zA-Z]*{_RIGHT}"
)


def recent(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", kept: int = KEPT) -> DataFrame:
    """The last ``kept`` turns of each conversation, without one of the assistant at their head."""
    last = turns.withColumn("_age", F.row_number().over(Window.partitionBy(conversation).orderBy(F.desc(turn)))).filter(F.col("_age") <= kept)
    first = F.min(turn).over(Window.partitionBy(conversation))
    return last.withColumn("_first", first).filter((F.col(turn) > F.col("_first")) | (F.col("role") != "assistant")).drop("_age", "_first")


def needs_rewrite(question: Column, earlier: Column) -> Column:
    """Whether a question points back: there are earlier turns, it is not blank, names nothing concrete and has a form that points."""
    asked = F.regexp_replace(question, r"^\s+|\s+$", "")
    return F.coalesce((earlier > 0) & (asked != "") & ~asked.rlike(_CONCRETE) & asked.rlike(_POINTING), F.lit(False))
