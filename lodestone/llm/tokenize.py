"""Encoding of texts with a byte-level BPE vocabulary.

A text is cut into words by the vocabulary's pattern; each word is merged on its own. A short
word is a contiguous array of part boundaries with the rank of each adjacent pair beside it:
the array is scanned for the smallest rank, that boundary is deleted, and the two neighbouring
ranks are refreshed. The scan is quadratic in the word, so longer words (runs of one sign, for
example) keep their pairs in a heap instead; the result is the same. Words recur, so every
task keeps a bounded table of words it has merged.

The vocabulary (about 1 MB, fixed) is read on the driver and broadcast.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that cuts a text into words before the merges of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SHORT = 64
REMEMBERED = 200_000
_NEVER = 1 << 60


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank (which is the id) from a rank file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines) if token}


def merge_short(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a word by repeated scans of its rank array."""
    bounds = list(range(len(word) + 1))
    get = ranks.get
    near = [get(word[i : i + 2], _NEVER) for i in range(len(word) - 1)]
    while near:
        least = min(near)
        if least == _NEVER:
            break
        at = near.index(least)
        del bounds[at + 1], near[at]
        if at < len(near):
            near[at] = get(word[bounds[at] : bounds[at + 2]], _NEVER)
        if at:
            near[at - 1] = get(word[bounds[at - 1] : bounds[at + 1]], _NEVER)
    return [ranks[word[a:b]] for a, b in zip(bounds, bounds[1:])]


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a word with its pairs in a heap; ties go to the left as in :func:`merge_short`."""
    n = len(word)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    end = list(range(1, n + 1))
    alive = [True] * n
    heap = [(ranks[word[i : i + 2]], i, i + 2) for i in range(n - 1) if word[i : i + 2] in ranks]
    heapq.heapify(heap)
    while heap:
        _, left, stop = heapq.heappop(heap)
        right = after[left] if alive[left] else n
        if right >= n or end[right] != stop or not alive[left]:
            continue
        alive[right] = False
        end[left] = stop
        after[left] = after[right]
        if after[left] < n:
            before[after[left]] = left
            if (rank := ranks.get(word[left : end[after[left]]])) is not None:
                heapq.heappush(heap, (rank, left, end[after[left]]))
        if before[left] >= 0 and (rank := ranks.get(word[before[left] : stop])) is not None:
            heapq.heappush(heap, (rank, before[left], stop))
    return [ranks[word[i : end[i]]] for i in range(n) if alive[i]]


class Encoder:
    """Text to ids, without special tokens (their strings are ordinary text)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.ranks, self.words, self.known = ranks, regex.compile(pattern).findall, {}

    def word(self, word: str) -> list[int]:
        data = word.encode()
        whole = self.ranks.get(data)
        ids = [whole] if whole is not None else (merge_short if len(data) <= SHORT else merge_long)(data, self.ranks)
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        if len(data) <= SHORT:
            self.known[word] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        get, extend = self.known.get, out.extend
        for word in self.words(text):
            extend(get(word) or self.word(word))
        return out


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``id_col, ids`` (list of int) for every row of ``df``; null and empty texts give an empty list.

    Rows are independent: no shuffle. Repeated rows come out as often as they go in, other
    columns are dropped, an empty table gives an empty table.
    """
    rows = df.select(id_col, text_col)
    with open(vocabulary, "rb") as file:
        content = df.sparkSession.sparkContext.broadcast(file.read())
    kind = rows.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder({base64.b64decode(t): int(r) for t, r in map(bytes.split, content.value.splitlines()) if t})
        for batch in batches:
            values, ends = array("i"), [0]
            for text in batch.column(1).to_pylist():
                if text:
                    values.extend(encoder.encode(text))
                ends.append(len(values))
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], [id_col, "ids"])

    return rows.mapInArrow(run, f"`{id_col}` {kind.simpleString()}, ids array<int>")


def decode(ids: list[int], ranks: dict[bytes, int]) -> str:
    """The text of ids, for round trips."""
    token = {rank: data for data, rank in ranks.items()}
    return b"".join(token[i] for i in ids).decode()
