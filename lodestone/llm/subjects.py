"""The subjects of each document, by labelling functions and a latent model of their accuracy.

Five labelling functions look at a document for each subject: a lexicon of word pairs (learned
from the rated documents), the sections (headings and paragraphs that use the words by which the
subject areas describe themselves), the address (the repository that a document's heading or path
names), the source, and the raters themselves. The first two share no evidence.
Each votes or abstains. How far each can be trusted is not given: per subject, a two-class
model (the document has the subject or not) with one table of votes per function and class is
fitted by expectation maximisation on the counts of vote patterns over all documents. A
document gets the subjects whose posterior probability reaches ``THRESHOLD``.

Code blocks, logs and mark-up are cut away; words written as code names are split.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.sources.tables import broadcast_if_small, checkpoint

THRESHOLD = 0.5
LEAST_DOCS, LEAST_SHARE, LEAST_LIFT = 3, 0.55, 2.0
#: The share of a paragraph's sentences that makes it one about a subject.
PARAGRAPH = 0.3
#: The most entries of the lexicon that are broadcast; a larger one is joined. Rows of sentences in a batch.
MOST_PAIRS, AT_ONCE = 200_000, 200_000
MOST_SUBJECTS = 256
_FENCE = re.compile(r"```.*?(?:```|\Z)|~~~.*?(?:~~~|\Z)", re.S)
_LOG = re.compile(r"^[^\w\n]{0,40}(?:\d{4}-\d\d-\d\d|\d\d:\d\d:\d\d).*$", re.M)
_START = re.compile(r"^[ \t]*(?:(?:/\*\*?|\*/|\*(?!\*)|>|//+|#+|[-+]|\d+\.)[ \t]*)+", re.M)
_CAMEL = re.compile(r"([a-z0-9])([A-Z])")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n(?=[A-Z])")
_WORD = re.compile(r"[^\W\d_]+")
_HEADING = re.compile(r"^[ \t]*(?:[*>/]+[ \t]*)?#{1,6}[ \t]+([^\n]+)$|^([^\n]{3,80})\n(?:={3,}|-{3,})[ \t]*$", re.M)
#: Words of a description that name no subject.
_COMMON = frozenset("with from that this their other such also only into acts topic results work things people".split())
#: Vote outcomes of each labelling function; 0 means it abstains for all but the first two.
VOTES = {"lexicon": 3, "section": 3, "address": 3, "source": 3, "raters": 3}
_ABSTAINS = ("address", "source", "raters")


@lru_cache(maxsize=500_000)
def _pair(a: str, b: str) -> int:
    return xxhash.xxh64_intdigest(f"{a} {b}") - (1 << 63)


def split(text: str) -> list[list[list[str]]]:
    """Paragraphs of sentences of words, without code, logs and mark-up; sentences of fewer than three words are left out."""
    text = _START.sub("", _LOG.sub("", _FENCE.sub("\n\n", text.replace("\r\n", "\n"))))
    out = []
    for part in re.split(r"\n[ \t]*\n", text):
        sentences = [words for words in (_WORD.findall(_CAMEL.sub(r"\1 \2", x).lower()) for x in _SENTENCE.split(part)) if len(words) >= 3]
        if sentences:
            out.append(sentences)
    return out


def hashed(parts: list[list[list[str]]]) -> list[list[list[int]]]:
    """The same with the hashed pairs of neighbouring words of each sentence."""
    return [[list({_pair(a, b) for a, b in zip(words, words[1:])}) for words in part] for part in parts]


def paragraphs(text: str) -> list[list[list[int]]]:
    """Paragraphs of sentences of hashed word pairs."""
    return hashed(split(text))


def stem(word: str) -> str:
    """A word without the ending of a plural."""
    return word[:-3] + "y" if word.endswith("ies") else word[:-2] if word.endswith(("ches", "shes", "sses", "xes")) else word[:-1] if word.endswith("s") and not word.endswith("ss") else word


def own_words(areas: list[tuple[str, str | None]]) -> dict[str, int]:
    """Each word that only one subject area has in its name or description, with the number of that area."""
    each = [{stem(w) for w in _WORD.findall(f"{name} {text or ''}".lower()) if len(w) >= 4 and w not in _COMMON} for name, text in areas]
    often = Counter(w for words in each for w in words)
    return {w: k for k, words in enumerate(each) for w in words if often[w] == 1}


def described(text: str, parts: list[list[list[str]]], own: dict[str, int], n: int) -> list[int]:
    """Votes of the sections for each of ``n`` subjects: 2 for a heading or two sentences of a paragraph with own words of the subject; one sentence may be a passing mention."""
    found = [0] * n
    for heading in map(" ".join, _HEADING.findall(text)):
        for word in _WORD.findall(heading.lower()):
            if (k := own.get(stem(word))) is not None:
                found[k] = 2
    for part in parts:
        hits = Counter(k for words in part for k in {own[x] for x in map(stem, words) if x in own})
        for k, count in hits.items():
            found[k] = max(found[k], 2 if count >= 2 else 0)
    return found


def _pairs(documents: DataFrame) -> DataFrame:
    """``doc_id, pair`` -- each word pair of each document once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, pairs = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = {p for part in paragraphs(text or "") for sentence in part for p in sentence}
                ids += [doc] * len(own)
                pairs += own
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(pairs, pa.int64())], ["doc_id", "pair"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, pair long")


def lexicon(documents: DataFrame, rated: DataFrame, subjects: list[str]) -> DataFrame:
    """``pair, k, weight`` -- word pair, subject number and weight, from all rated documents.

    A pair speaks for a subject if at least ``LEAST_DOCS`` rated documents hold it and the
    subject's share among them is ``LEAST_SHARE`` and ``LEAST_LIFT`` times its usual share.
    """
    own = rated.groupBy("doc_id").agg(F.collect_set("subject").alias("subjects"))
    size = own.agg(F.count(F.lit(1)), *[F.sum(F.array_contains("subjects", s).cast("long")) for s in subjects]).first()
    n, usual = size[0], [((x or 0) + 0.5) / (size[0] + 1) for x in size[1:]]
    if not n or not subjects:
        return documents.sparkSession.createDataFrame([], "pair long, k int, weight double")
    held = _pairs(documents.join(own.select("doc_id"), "doc_id", "left_semi")).join(own, "doc_id")
    share = lambda k, s: (F.sum(F.array_contains("subjects", s).cast("long")) + 2 * usual[k]) / (F.count(F.lit(1)) + 2)
    counted = held.groupBy("pair").agg(F.count(F.lit(1)).alias("docs"), *[share(k, s).alias(f"s{k}") for k, s in enumerate(subjects)]).filter(F.col("docs") >= LEAST_DOCS)
    least = [max(LEAST_SHARE, min(LEAST_LIFT * u, 1 - (1 - u) / LEAST_LIFT / 1.5)) for u in usual]
    each = [F.when(F.col(f"s{k}") >= least[k], F.struct(F.lit(k).alias("k"), F.log(F.col(f"s{k}") / usual[k]).alias("weight"))) for k in range(len(subjects))]
    return counted.select("pair", F.explode(F.array_compact(F.array(*each))).alias("found")).select("pair", "found.k", "found.weight")


def weigh(parts: list[list[list[int]]], words: dict[int, list[tuple[int, float]]], strong: list[float], n: int) -> list[int]:
    """Votes of the lexicon for each of ``n`` subjects."""
    lexical = [0] * n
    for part in parts:
        hits: Counter = Counter()
        for sentence in part:
            score: Counter = Counter()
            for pair in sentence:
                for k, weight in words.get(pair, ()):
                    score[k] += weight
            if score:
                k, weight = max(score.items(), key=lambda x: (x[1], -x[0]))
                if weight >= strong[k]:
                    hits[k] += 1
        for k, count in hits.items():
            lexical[k] = max(lexical[k], 2 if count >= 2 and count / len(part) >= PARAGRAPH else 1)
    return lexical


def _sentences(documents: DataFrame) -> DataFrame:
    """``doc_id, part, sentences, sentence, pair`` -- each word pair of each sentence, with the number of sentences in its paragraph."""
    names = ["doc_id", "part", "sentences", "sentence", "pair"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows += [(doc, i, len(part), j, pair) for i, part in enumerate(paragraphs(text)) for j, pairs in enumerate(part) for pair in pairs]
                if len(rows) >= AT_ONCE:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64()]
    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, part int, sentences int, sentence int, pair long")


def _weighed(documents: DataFrame, words: DataFrame, strong: list[float]) -> DataFrame:
    """``doc_id, lexicon`` as of :func:`weigh`, by joins, for a lexicon of any size; documents without a vote are left out."""
    n, at = len(strong), ["doc_id", "part", "sentences"]
    score = _sentences(documents).join(words, "pair").groupBy(*at, "sentence", "k").agg(F.sum("weight").alias("weight"))
    best = score.groupBy(*at, "sentence").agg(F.max(F.struct("weight", (-F.col("k")).alias("k"))).alias("best")).select(*at, (-F.col("best.k")).alias("k"), F.col("best.weight").alias("weight"))
    hits = best.filter(F.col("weight") >= F.get(F.array(*[F.lit(x) for x in strong]), F.col("k"))).groupBy(*at, "k").agg(F.count(F.lit(1)).alias("hits"))
    vote = F.max(F.when((F.col("hits") >= 2) & (F.col("hits") / F.col("sentences") >= PARAGRAPH), 2).otherwise(1))
    each = hits.groupBy("doc_id", "k").agg(vote.alias("lexical")).groupBy("doc_id")
    return each.agg(F.array(*[F.coalesce(F.max(F.when(F.col("k") == k, F.col("lexical"))), F.lit(0)).cast("tinyint") for k in range(n)]).alias("lexicon"))


def votes(documents: DataFrame, areas: DataFrame, labels: DataFrame, repos: DataFrame) -> DataFrame:
    """``doc_id, subject`` and one vote per labelling function, for every document with text and every subject.

    Votes are 0, 1 or 2. Lexicon: no sentence, only mentions, a paragraph; section: 0, or 2 for a heading or paragraph. Address,
    source and raters: abstains, another subject, this subject. Labels of unknown subjects and
    documents are ignored, repeated ones count once.
    """
    named = areas.filter("subject is not null").groupBy("subject").agg(F.max("description").alias("description")).orderBy("subject").limit(MOST_SUBJECTS + 1).collect()
    subjects, own_terms = [r[0] for r in named], own_words([tuple(r) for r in named])
    if len(subjects) > MOST_SUBJECTS:
        raise ValueError(f"more than {MOST_SUBJECTS} subjects")
    rated = labels.filter(F.col("subject").isin(subjects) & F.col("doc_id").isNotNull()).select("doc_id", "subject").distinct()
    docs = documents.filter("doc_id is not null and text is not null").select(F.col("doc_id").cast("long"), "text", "source", "path").dropDuplicates(["doc_id"])
    words, n = checkpoint(lexicon(docs, rated, subjects)), len(subjects)
    top = {r.k: r.top for r in words.groupBy("k").agg(F.max("weight").alias("top")).collect()}
    strong = [min(1.0, 0.9 * top.get(k, 1.0)) for k in range(n)]  # a usual subject cannot reach a high lift, so its sentences need less weight
    known: dict[int, list[tuple[int, float]]] | None = None
    if words.count() <= MOST_PAIRS:
        known = {}
        for row in words.collect():
            known.setdefault(row.pair, []).append((row.k, row.weight))
    shared = docs.sparkSession.sparkContext.broadcast(known or {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            parts = [split(text) for text in texts]
            lexical = [weigh(hashed(p), shared.value, strong, n) if shared.value else [0] * n for p in parts]
            section = [described(text, p, own_terms, n) for text, p in zip(texts, parts)]
            paths = [path or "" for path in batch.column("path").to_pylist()]
            places = [list(dict.fromkeys([(re.search(r"[\w.-]*[A-Za-z][\w.-]*", text) or [""])[0].lower(), *path.lower().split("/")])) for text, path in zip(texts, paths)]
            small = pa.list_(pa.int8())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("source"), pa.array(places, pa.list_(pa.string())), pa.array(lexical, small), pa.array(section, small)],
                ["doc_id", "source", "places", "lexicon", "section"],
            )

    seen = docs.mapInArrow(run, "doc_id long, source string, places array<string>, lexicon array<tinyint>, section array<tinyint>")
    if known is None:
        said = _weighed(docs, words, strong).withColumnRenamed("lexicon", "said")
        seen = seen.join(said, "doc_id", "left").select("doc_id", "source", "places", F.coalesce("said", "lexicon").alias("lexicon"), "section")
    seen = checkpoint(seen)  # read twice
    own = rated.groupBy("doc_id").agg(F.collect_set("subject").alias("rated"))
    homes = repos.filter(F.col("subject").isin(subjects) & F.col("repo").isNotNull()).groupBy(F.lower("repo").alias("place")).agg(F.min("subject").alias("home"))
    named_places = seen.select("doc_id", F.posexplode("places").alias("at", "place")).join(broadcast_if_small(homes), "place")
    addressed = named_places.groupBy("doc_id").agg(F.min_by("home", "at").alias("home"))  # the heading before the path
    usual = docs.select("doc_id", "source").join(rated, "doc_id")
    by_source = usual.filter("source is not null").groupBy("source", "subject").agg(F.count(F.lit(1)).alias("n"))
    total = by_source.groupBy("source").agg(F.sum("n").alias("total"), F.max_by("subject", F.struct("n", "subject")).alias("often"), F.max("n").alias("most"))
    leading = total.filter("total >= 20 and most >= 0.5 * total").select("source", "often")
    wide = seen.join(own, "doc_id", "left").join(addressed, "doc_id", "left").join(broadcast_if_small(leading), "source", "left")
    says = lambda column: F.when(F.col(column).isNull(), 0).when(F.col(column) == F.col("subject"), 2).otherwise(1)
    each = wide.select("doc_id", "lexicon", "section", "home", "often", "rated", F.posexplode(F.array(*[F.lit(s) for s in subjects])).alias("k", "subject"))
    return each.select(
        "doc_id", "subject",
        F.get("lexicon", F.col("k")).cast("int").alias("lexicon"), F.get("section", F.col("k")).cast("int").alias("section"),
        says("home").alias("address"), says("often").alias("source"),
        F.when(F.col("rated").isNull(), 0).when(F.array_contains("rated", F.col("subject")), 2).otherwise(1).alias("raters"),
    )


def fit(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> np.ndarray:
    """Posterior probability of the subject for each vote pattern, by expectation maximisation.

    ``patterns``: one row per pattern, one column per labelling function in the order of ``VOTES``.
    """
    names = list(VOTES)
    if not len(patterns):
        return np.zeros(0)
    seen = np.array([[name not in _ABSTAINS or row[j] > 0 for j, name in enumerate(names)] for row in patterns], dtype=bool).reshape(len(patterns), len(names))
    post = np.where(patterns[:, 0] == 2, 0.95, np.where(patterns[:, 4] == 2, 0.3, 0.02))
    for _ in range(rounds):
        both = np.stack([counts * (1 - post), counts * post])
        prior = (both.sum(1) + 1) / (both.sum() + 2)
        log = np.log(prior)[:, None] + np.zeros((2, len(patterns)))
        for j, name in enumerate(names):
            table = np.full((2, VOTES[name]), 0.5)
            for y in (0, 1):
                np.add.at(table[y], patterns[seen[:, j], j], both[y, seen[:, j]])
            table = np.log(table / table.sum(1, keepdims=True))
            log += np.where(seen[:, j], table[:, patterns[:, j]], 0.0)
        new = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
        if np.abs(new - post).max() < 1e-9:
            break
        post = new
    return post


def posteriors(voted: DataFrame) -> DataFrame:
    """``doc_id, subject, posterior`` for every document and subject of :func:`votes`."""
    names = list(VOTES)
    voted = checkpoint(voted)
    patterns = voted.groupBy("subject", *names).agg(F.count(F.lit(1)).alias("n")).orderBy("subject", *names).toPandas()  # at most 3^5 rows a subject
    if not len(patterns):
        return voted.select("doc_id", "subject", F.lit(0.0).alias("posterior"))
    tables = []
    for _, own in patterns.groupby("subject"):
        tables.append(own.assign(posterior=fit(own[names].to_numpy(), own["n"].to_numpy(float))).drop(columns="n"))
    import pandas as pd

    known = voted.sparkSession.createDataFrame(pd.concat(tables))
    return voted.join(F.broadcast(known), ["subject", *names]).select("doc_id", "subject", "posterior")


def assigned(documents: DataFrame, areas: DataFrame, labels: DataFrame, repos: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, subject`` of the subjects each document has at least one paragraph about.

    Null, empty and blank texts have none, nor does any document while no label can be learned from.
    """
    chosen = posteriors(votes(documents, areas, labels, repos)).filter(F.col("posterior") >= threshold)
    return chosen.select("doc_id", "subject")


def composition(assigned_subjects: DataFrame, documents: DataFrame) -> DataFrame:
    """``subject, documents, share`` of the corpus (all documents, also those without a subject)."""
    n = documents.agg(F.countDistinct("doc_id").alias("n"))
    return assigned_subjects.groupBy("subject").agg(F.countDistinct("doc_id").alias("documents")).join(F.broadcast(n)).select("subject", "documents", F.round(F.col("documents") / F.col("n"), 6).alias("share"))
