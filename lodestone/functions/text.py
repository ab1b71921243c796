"""Column functions on identifiers, words and paths. All stay in the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _folding() -> tuple[str, str]:
    """Latin letters with a diacritic and the plain letters they fold to, by Unicode decomposition."""
    pairs = [(c, unicodedata.normalize("NFD", c)[0]) for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)])]
    pairs = [(a, b) for a, b in pairs if a != b and b.isalpha()]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_FROM, _TO = _folding()
#: Words of a question that carry no topic.
STOPWORDS = tuple(
    "how why what where when who which whose does did are the and for with this that its into from has have can will would should you your they them use used get".split()
)


def fold(text: Column) -> Column:
    """Lower case without diacritics; null stays null."""
    return F.regexp_replace(F.translate(F.lower(text), _FROM, _TO), r"\p{Mn}+", "")


def words(text: Column) -> Column:
    """The index's tokens: runs of letters and digits of the folded text; null gives an empty array."""
    return F.coalesce(F.regexp_extract_all(fold(text), F.lit(r"([\p{L}\p{N}]+)"), 1), F.array().cast("array<string>"))


def split_identifiers(text: Column) -> Column:
    """``getUserById`` to ``get user by id``: camel case, acronyms, underscores and dots split; lower case."""
    camel = F.regexp_replace(text, r"([a-z0-9])([A-Z])", "$1 $2")
    acronym = F.regexp_replace(camel, r"([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.lower(F.trim(F.regexp_replace(acronym, r"[_.]+", " ")))


def symbol_text(symbol: Column) -> Column:
    """What is indexed for a symbol: itself and its parts."""
    return F.concat_ws(" ", symbol, split_identifiers(symbol))


def query_terms(query: Column) -> Column:
    """Distinct lower-case terms of a query, each followed by its identifier parts, in order of first occurrence."""
    tokens = F.coalesce(F.regexp_extract_all(query, F.lit(r"([\p{L}\p{N}_]+)"), 1), F.array().cast("array<string>"))
    parts = F.flatten(F.transform(tokens, lambda t: F.concat(F.array(F.lower(t)), F.split(split_identifiers(t), " "))))
    return F.array_distinct(F.filter(parts, lambda p: p != ""))


def short_name(symbol: Column) -> Column:
    """What follows the last dot."""
    return F.substring_index(symbol, ".", -1)


def is_code_shaped(token: Column) -> Column:
    return token.rlike(r"[./_]|[a-z][A-Z]")


def query_symbols(query: Column) -> Column:
    """Distinct identifier-like tokens of at least two signs, dotted and slashed ones whole."""
    found = F.regexp_extract_all(query, F.lit(r"([A-Za-z_$][A-Za-z0-9_$]*(?:[./][A-Za-z_$][A-Za-z0-9_$]*)*)"), 1)
    return F.array_distinct(F.filter(F.coalesce(found, F.array().cast("array<string>")), lambda t: F.length(t) >= 2))


def query_identifiers(query: Column) -> Column:
    """Distinct spans in backticks and words with an inner capital or an underscore, of at least four signs."""
    quoted = F.regexp_extract_all(query, F.lit(r"`([^`]+)`"), 1)
    shaped = F.filter(F.regexp_extract_all(query, F.lit(r"([A-Za-z][A-Za-z0-9_]*)"), 1), lambda t: t.rlike("[a-z][A-Z]|[A-Z][a-z].*[A-Z]|_"))
    return F.array_distinct(F.filter(F.concat(quoted, shaped), lambda t: F.length(t) >= 4))


def significant_terms(query: Column) -> Column:
    """Distinct lower-case ASCII words of at least three signs that are no stop words."""
    found = F.coalesce(F.regexp_extract_all(F.lower(query), F.lit(r"([a-z0-9]+)"), 1), F.array().cast("array<string>"))
    return F.array_except(F.filter(F.array_distinct(found), lambda t: F.length(t) >= 3), F.array(*[F.lit(w) for w in STOPWORDS]))


def identifier_key(symbol: Column) -> Column:
    """An identifier's parts (camel case, underscores, spaces) in lower case, sorted, so that order and case don't count."""
    parts = F.split(F.lower(F.regexp_replace(F.regexp_replace(symbol, r"([a-z0-9])([A-Z])", "$1 $2"), r"[_\s]+", " ")), " ")
    return F.array_join(F.array_sort(F.filter(parts, lambda p: p != "")), " ")


def utf16_length(text: Column) -> Column:
    return F.octet_length(F.encode(text, "UTF-16BE")) / 2
