"""Evaluation passages inside a corpus.

Items and documents are reduced to words (entities, tags, mark-up, punctuation, case, line
starts and line breaks do not count), each word with its offset in the original. One
Aho-Corasick automaton holds every run of ``SEED`` words of the item texts and every question;
a document's words are scanned once. A copy of ``LEAST`` words in which at most one of
``WINDOW`` consecutive words is edited always holds an unedited run of at least ``SEED``
words, so the scan misses none. Each hit is then extended in both directions, spending an
edit only after enough unedited words, and counts if ``LEAST`` words of the item agree.

Items are cut into blocks of at most ``BLOCK_BYTES``; each block is broadcast and has an automaton
of its own, which a worker builds once, and the corpus is scanned with one after the other. The
corpus is not shuffled, and no number of items is too large.
"""

from __future__ import annotations

import html
import re
import uuid
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.sources.tables import checkpoint

SEED, LEAST, WINDOW = 6, 12, 8
BLOCK_BYTES = 8 << 20
SHARED_BY = 3
#: Stands between a text and its comments.
BETWEEN = "\0"
_WORD = re.compile(r"[^\W_]+")
_TAG = re.compile(r"</?[A-Za-z][^<>\n]{0,200}>", re.S)
_ENTITY = re.compile(r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,30});")
_HIDDEN = re.compile("[­​-‏⁠﻿]")
_BREAK = re.compile(r"(?<=[^\W\d_])-\n[ \t>*#/]*(?=[^\W\d_])")


def _masked(text: str, pattern: re.Pattern, keep) -> tuple[str, list[tuple[int, int]]]:
    """``text`` with matches replaced, and (position in result, shift to the original) after each."""
    out, shifts, last, length = [], [], 0, 0
    for m in pattern.finditer(text):
        piece = text[last : m.start()]
        new = keep(m.group())
        out += [piece, new]
        length += len(piece) + len(new)
        last = m.end()
        shifts.append((length, last - length))
    out.append(text[last:])
    return "".join(out), shifts


def _back(shifts: list[tuple[int, int]], at: int, side) -> int:
    """The position before masking of a position after it."""
    k = side(shifts, at, key=lambda s: s[0])
    return at + (shifts[k - 1][1] if k else 0)


def _without_comments(text: str) -> tuple[str, list[tuple[int, str]]]:
    """A text with blanks for its comments, and the comments: where each one's text begins, and that text."""
    out, inner, at = [], [], 0
    while (start := text.find("<!--", at)) >= 0 and (end := text.find("-->", start + 4)) >= 0:
        out += [text[at:start], " " * (end + 3 - start)]
        inner.append((start + 4, text[start + 4 : end]))
        at = end + 3
    return "".join([*out, text[at:]]), inner


def words(text: str, spans: bool = False) -> tuple[list[str], list[tuple[int, int]]]:
    """The words of a text in lower case and, with ``spans``, where each stands in the text itself.

    Comments interrupt nothing; their own words follow, each comment set off by two words that no text has (one could pass for an edit).
    """
    inner: list[tuple[int, str]] = []
    if "<!--" in text:
        text, inner = _without_comments(text)
    plain, places = _words(text, spans)
    for start, part in inner:
        more, at = _words(part, spans)
        plain += [BETWEEN, BETWEEN, *more]
        if spans:
            places += [(start, start), (start, start), *((start + a, start + b) for a, b in at)]
    return plain, places


def _words(text: str, spans: bool) -> tuple[list[str], list[tuple[int, int]]]:
    steps = []
    for pattern, keep in ((_TAG, lambda _: " "), (_ENTITY, html.unescape), (_HIDDEN, lambda _: ""), (_BREAK, lambda _: "")):
        if pattern.search(text):
            text, shifts = _masked(text, pattern, keep)
            steps.append(shifts)
    found = list(_WORD.finditer(text))
    plain = [m.group().lower() for m in found]
    if not spans:
        return plain, []
    places = []
    for m in found:
        a, b = m.span()
        for shifts in reversed(steps):
            a, b = _back(shifts, a, bisect_right), _back(shifts, b, bisect_left)
        places.append((a, b))
    return plain, places


def _opening(text: str) -> list[str]:
    """The words of a text's first sentence."""
    return words(re.split(r"(?<=[.!?:])\s", text, maxsplit=1)[0])[0]


def instructions(texts: list[str], shared_by: int = SHARED_BY) -> set[tuple[str, ...]]:
    """The opening sentences that at least ``shared_by`` items begin with, as words."""
    first = Counter(tuple(_opening(t)) for t in texts)
    return {opening for opening, n in first.items() if n >= shared_by and opening}


def _extend(item: list[str], doc: list[str], i: int, j: int, step: int, since: int, budget: bool) -> tuple[int, int]:
    """Most item words that agree from (i, j) on in direction ``step``, and the last document word used."""
    best: dict[tuple[int, int], tuple[int, int]] = {}

    def go(i: int, j: int, since: int) -> tuple[int, int]:
        n, start = 0, j
        while 0 <= i < len(item) and 0 <= j < len(doc) and item[i] == doc[j]:
            i, j, n, since = i + step, j + step, n + 1, since + 1
        got = (n, j - step if n else start - step)
        if budget and since >= WINDOW - 1 and 0 <= i < len(item) and 0 <= j < len(doc):
            if (i, j) not in best:
                best[i, j] = max((go(*to, 0) for to in ((i + step, j + step), (i, j + step), (i + step, j))), key=lambda r: r[0])
            more, last = best[i, j]
            if more:
                return n + more, last
        return got

    return go(i, j, since)


class Scanner:
    """The automaton over a block of items and the check of its hits; ``openings``: instructions that are no part of them."""

    def __init__(self, items: list[tuple[int, str | None, str | None]], openings: set[tuple[str, ...]] | None = None):
        import ahocorasick

        self.items: dict[int, list[str]] = {}
        grams: dict[str, list[tuple[str, int, int]]] = {}
        openings = instructions([t for _, _, t in items if t]) if openings is None else openings
        for item, question, text in items:
            body = words(text or "")[0]
            for opening in openings:
                if tuple(body[: len(opening)]) == opening:
                    body = body[len(opening) :]
                    break
            self.items[item] = body
            for at in range(len(body) - SEED + 1):
                grams.setdefault(" ".join(["", *body[at : at + SEED], ""]), []).append(("passage", item, at))
            asked = words(question or "")[0]
            if asked:
                grams.setdefault(" ".join(["", *asked, ""]), []).append(("question", item, len(asked)))
        self.automaton = ahocorasick.Automaton()
        for gram, places in grams.items():
            self.automaton.add_word(gram, (gram.count(" ") - 1, places))
        self.any = bool(grams)
        if self.any:
            self.automaton.make_automaton()

    def scan(self, text: str, spans: bool = False) -> list[tuple[int, str, int, int, int]]:
        """``item, kind, words that agree, start, end`` -- the best passage of each item, and each question."""
        if not self.any or not text:
            return []
        doc, places = words(text)
        line = " ".join(["", *doc, ""])
        hits = [(end, n, where) for end, (n, where) in self.automaton.iter(line)]
        if not hits:
            return []
        if spans:
            places = words(text, True)[1]
        index, count, last = {}, 0, 0
        for end, _, _ in sorted(hits, key=lambda h: h[0]):
            count += line.count(" ", last, end + 1)
            last = end + 1
            index[end] = count - 1
        found: dict[tuple[int, str], tuple[int, int, int]] = {}
        done: set[tuple[int, int, int]] = set()
        for end, n, where in hits:
            at = index[end] - n
            for kind, item, offset in where:
                if kind == "question":
                    got = (n, at, at + n - 1)
                else:
                    if (item, offset - 1, at - 1) in done:
                        done.add((item, offset, at))
                        continue
                    done.add((item, offset, at))
                    got = self._check(self.items[item], doc, offset, at)
                    if got[0] < LEAST:
                        continue
                if got[0] > found.get((item, kind), (0,))[0]:
                    found[item, kind] = got
        place = (lambda a, b: (places[a][0], places[b][1])) if spans else (lambda a, b: (a, b))
        return [(item, kind, n, *place(a, b)) for (item, kind), (n, a, b) in sorted(found.items())]

    @staticmethod
    def _check(item: list[str], doc: list[str], offset: int, at: int) -> tuple[int, int, int]:
        run = 0
        while offset + run < len(item) and at + run < len(doc) and item[offset + run] == doc[at + run]:
            run += 1
        back = 0
        while offset - back > 0 and at - back > 0 and item[offset - back - 1] == doc[at - back - 1]:
            back += 1
        whole = run + back
        sides = [(True, True)] if whole >= WINDOW - 1 else [(True, False), (False, True)]
        best = (0, 0, 0)
        for left, right in sides:
            # an edit right at the run's edge needs no unedited words before it, only none on the other side too near
            r, stop = _extend(item, doc, offset + run, at + run, 1, WINDOW - 1, right)
            l, start = _extend(item, doc, offset - back - 1, at - back - 1, -1, WINDOW - 1, left)
            best = max(best, (whole + l + r, start, stop))
        return best


_BUILT: dict[str, Scanner] = {}


def _scanner(name: str, items: list[tuple], openings: set[tuple[str, ...]]) -> Scanner:
    """The scanner of a block, built once in each worker; only the last one is kept."""
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = Scanner(items, openings)
    return _BUILT[name]


def shared_openings(items: DataFrame, shared_by: int = SHARED_BY) -> set[tuple[str, ...]]:
    """The opening sentences that at least ``shared_by`` items begin with; one item in ``shared_by`` can have one at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([" ".join(_opening(t)) for t in batch.column(0).to_pylist()], pa.string())], ["opening"])

    first = items.filter("text is not null").select("text").mapInArrow(run, "opening string").filter("opening <> ''")
    often = first.groupBy("opening").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= shared_by)
    return {tuple(r.opening.split(" ")) for r in often.select("opening").collect()}


def leaked_passages(documents: DataFrame, items: DataFrame, spans: bool = True, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id, item_id, kind, n_words, start, end`` of every item found in a document.

    ``kind`` is ``passage`` (at least 12 words of the item's text; the instruction that several
    items open with does not count) or ``question``. ``start`` and ``end`` are offsets of code
    points in the document's own text (with ``spans=False`` word positions, which costs less).
    Null and empty texts carry nothing, items without text are never found, repeated documents
    or items come out once each.
    """
    context = documents.sparkSession.sparkContext
    kept = items.select("item_id", "question", "text").distinct()
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + F.coalesce(F.octet_length("question"), F.lit(0))
    blocks = max(1, -(-(kept.agg(F.sum(size.cast("long"))).first()[0] or 0) // block_bytes))
    openings = context.broadcast(shared_openings(kept))
    schema = "doc_id long, item_id long, kind string, n_words int, start int, end int"

    def scanned(own: DataFrame) -> DataFrame:
        shared, name = context.broadcast([tuple(r) for r in own.orderBy("item_id").collect()]), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scanner = _scanner(name, shared.value, openings.value)
            for batch in batches:
                rows = [(doc, *hit) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if text for hit in scanner.scan(text, spans)]
                columns = list(zip(*rows)) or [[]] * 6
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], ["doc_id", "item_id", "kind", "n_words", "start", "end"])

        found = documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)
        if blocks == 1:
            return found
        found = checkpoint(found)  # so that only one block of items is held at a time
        shared.destroy()
        return found

    parts = [scanned(kept.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b)) for b in range(blocks)]
    return reduce(DataFrame.unionByName, parts).distinct()
