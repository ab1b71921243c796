"""Ranked lexical search: BM25 over a symbol column and a body column.

A query is a disjunction of quoted terms. A term whose text has several tokens is a phrase: its
tokens must stand side by side in one column. Of the postings only those of terms that some query
holds are kept; each tells where a phrase would begin, so that single words and phrases are
matched by the same aggregation.

``search`` looks up a few queries in the postings. ``search_all`` answers a large query set by going
through the documents: pairs of query and document are scored where the document is read, and
only the best of each query leave a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text
from lodestone.functions.best import Best
from lodestone.sources.tables import broadcast_if_small, once

K1, B = 1.2, 0.75
LEAST_IDF = 1e-6
#: Documents that a task scores at once, and pairs of query and term that are sent to the tasks at once.
BLOCK, MOST_TERMS = 32_768, 1_000_000


def indexed(chunks: DataFrame, doc: str = "seq", symbol: str = "symbol", body: str = "code") -> DataFrame:
    """``doc, symbol_tokens, body_tokens, n_tokens`` of every document, repeated rows once; nulls are empty texts."""
    rows = once(chunks.select(F.col(doc).alias("doc"), F.col(symbol).alias("symbol"), F.col(body).alias("body")), "doc")
    tokens = rows.select("doc", text.words(text.symbol_text(F.col("symbol"))).alias("symbol_tokens"), text.words(F.col("body")).alias("body_tokens"))
    return tokens.withColumn("n_tokens", F.size("symbol_tokens") + F.size("body_tokens"))


def corpus_stats(index: DataFrame) -> DataFrame:
    """One row: ``docs, tokens, avgdl``."""
    return index.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("tokens"), F.avg("n_tokens").alias("avgdl"))


def document_frequency(posted: DataFrame) -> DataFrame:
    """``term, docs, occurrences`` over all terms of the postings."""
    each = posted.groupBy("term", "doc").agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy("term").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("occurrences"))


def query_phrases(queries: DataFrame) -> DataFrame:
    """``query_id, phrase, tokens`` of each distinct term of each query; a term without a token matches nothing."""
    terms = queries.select("query_id", F.explode(text.query_terms(F.col("query_text"))).alias("phrase"))
    return terms.withColumn("tokens", text.words(F.col("phrase"))).filter(F.size("tokens") > 0)


def postings(index: DataFrame) -> DataFrame:
    """``term, doc, n_tokens, part, pos`` -- every occurrence of every term; ``part`` is ``s`` in the symbol and ``b`` in the body."""
    column = lambda name, part: F.transform(F.col(name), lambda t, i: F.struct(t.alias("term"), F.lit(part).alias("part"), i.alias("pos")))
    each = index.select("doc", "n_tokens", F.explode(F.concat(column("symbol_tokens", "s"), column("body_tokens", "b"))).alias("p"))
    return each.select("p.term", "doc", "n_tokens", "p.part", "p.pos")


def phrase_matches(posted: DataFrame, phrases: DataFrame, symbol_weight: float = 1.0, body_weight: float = 1.0) -> DataFrame:
    """``phrase, doc, n_tokens, tf`` -- weighted occurrences of each distinct phrase in each document."""
    wanted = phrases.select("phrase", "tokens").distinct().select("phrase", F.size("tokens").alias("size"), F.posexplode("tokens").alias("offset", "term"))
    hits = posted.join(broadcast_if_small(wanted), "term").select("doc", "n_tokens", "phrase", "size", "part", (F.col("pos") - F.col("offset")).alias("start"))
    hits = hits.repartition("doc", "phrase")  # serves both aggregations; a common word is spread over its documents
    whole = hits.groupBy("doc", "phrase", "n_tokens", "size", "part", "start").agg(F.count(F.lit(1)).alias("n")).filter("n = size")
    weight = F.when(F.col("part") == "s", F.lit(symbol_weight)).otherwise(F.lit(body_weight))
    return whole.groupBy("doc", "phrase", "n_tokens").agg(F.sum(weight).alias("tf"))


def search(posted: DataFrame, docs: DataFrame, queries: DataFrame, limit: int = 50, symbol_weight: float = 1.0, body_weight: float = 1.0) -> DataFrame:
    """``query_id, doc, score, rank`` of the ``limit`` best documents of each query; ties go to the smaller doc.

    ``posted``: rows of :func:`postings`; ``docs``: doc, n_tokens of all documents. The inverse
    document frequency is floored at 1e-6. Null, empty and signless queries, and queries none of
    whose terms occurs, have no rows.
    """
    phrases = query_phrases(queries)
    matches = phrase_matches(posted, phrases, symbol_weight, body_weight)  # read twice from one shuffle
    found = matches.groupBy("phrase").agg(F.count(F.lit(1)).alias("n"))
    idf = found.crossJoin(F.broadcast(corpus_stats(docs))).select("phrase", "avgdl", F.log((F.col("docs") - F.col("n") + 0.5) / (F.col("n") + 0.5)).alias("idf"))  # one row of totals
    idf = idf.withColumn("idf", F.when(F.col("idf") <= 0, LEAST_IDF).otherwise(F.col("idf")))
    norm = F.col("tf") + K1 * (1 - B + B * F.col("n_tokens") / F.col("avgdl"))
    weighed = matches.join(idf, "phrase").select("phrase", "doc", (F.col("idf") * F.col("tf") * (K1 + 1) / norm).alias("part"))
    scored = weighed.join(broadcast_if_small(phrases.select("query_id", "phrase")), "phrase").groupBy("query_id", "doc").agg(F.sum("part").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "doc")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


class _Terms:
    """The terms of a query set as runs of tokens (``patterns``, parted by spaces), to be found in batches of documents."""

    def __init__(self, patterns: list[str]):
        runs = [p.split(" ") for p in patterns]
        self.count, self.vocabulary = len(patterns), pa.array(sorted({t for run in runs for t in run}), pa.string())
        number = {t: i for i, t in enumerate(self.vocabulary.to_pylist())}
        self.single = np.full(len(number), -1, np.int64)
        for k, run in enumerate(runs):
            if len(run) == 1:
                self.single[number[run[0]]] = k
        self.longer = [(k, [number[t] for t in run]) for k, run in enumerate(runs) if len(run) > 1]

    def found(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row of the batch, pattern, and how often it stands in one column of that row; each pair once, by row."""
        keys = []
        for name in ("symbol_tokens", "body_tokens"):
            lists = batch.column(name)
            row = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            ids = pc.index_in(lists.flatten(), value_set=self.vocabulary).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            hit = np.flatnonzero(ids >= 0)
            own = self.single[ids[hit]]
            keys.append((row[hit] * self.count + own)[own >= 0])
            if self.longer and len(hit):
                by = hit[np.argsort(ids[hit], kind="stable")]
                heads = np.array([run[0] for _, run in self.longer])
                for (k, run), a, b in zip(self.longer, np.searchsorted(ids[by], heads), np.searchsorted(ids[by], heads, "right")):
                    at = by[a:b]
                    for j, term in enumerate(run[1:], 1):
                        at = at[at + j < len(ids)]
                        at = at[(ids[at + j] == term) & (row[at + j] == row[at])]
                    keys.append(row[at] * self.count + k)
        key, times = np.unique(np.concatenate(keys), return_counts=True)
        return key // max(self.count, 1), key % max(self.count, 1), times


def _scored(best: Best, asked: list[np.ndarray], count: int, docs: np.ndarray, row: np.ndarray, term: np.ndarray, part: np.ndarray) -> None:
    """Add the scores of a block of documents, given the parts that terms add to rows."""
    order = np.argsort(term, kind="stable")
    row, part, bound = row[order], part[order], np.searchsorted(term[order], np.arange(count + 1))
    total, given, limit = np.zeros(len(docs)), [], best.ids.shape[1]

    def hand_over() -> None:
        if given:
            best.add(*map(np.concatenate, zip(*given)))
            given.clear()

    for q, terms in enumerate(asked):
        spans = [slice(bound[t], bound[t + 1]) for t in terms if bound[t] < bound[t + 1]]
        if not spans:
            continue
        for s in spans:
            total[row[s]] += part[s]  # a term has a row once
        touched = np.concatenate([row[s] for s in spans]) if len(spans) > 1 else row[spans[0]]
        high = np.unique(touched[total[touched] >= best.floor[q] - 1e-8])
        score = total[high]
        if len(high) > limit:
            near = score.round(9)
            least = np.partition(near, -limit)[-limit]
            high, score = high[near >= least], score[near >= least]
        given.append((np.full(len(high), q), docs[high], score))
        total[touched] = 0
        if len(given) == 1024:
            hand_over()
    hand_over()


def _search_slice(tokens: DataFrame, phrases: DataFrame, stats, limit: int) -> DataFrame:  # noqa: ANN001
    spark, doc_type = tokens.sparkSession, dict(tokens.dtypes)["doc"]
    pairs = phrases.toArrow()
    queries, patterns = (pairs.column(c).combine_chunks().dictionary_encode() for c in ("query_id", "pattern"))
    number, term = queries.indices.to_numpy(zero_copy_only=False), patterns.indices.to_numpy(zero_copy_only=False)
    order = np.lexsort((term, number))
    lists = np.split(term[order], np.flatnonzero(np.diff(number[order])) + 1) if len(term) else []
    alike: dict[bytes, int] = {}  # queries of the same terms are answered once
    stands = pa.array([alike.setdefault(own.tobytes(), len(alike)) for own in lists], pa.int32())
    asked = [np.frombuffer(own, term.dtype) for own in alike]
    same = spark.createDataFrame(pa.table({"asked": stands, "query_id": queries.dictionary.take(pa.array(np.unique(number)))}), f"asked int, query_id {dict(phrases.dtypes)['query_id']}")
    terms = spark.sparkContext.broadcast(_Terms(patterns.dictionary.to_pylist()))
    read = tokens.select("doc", "n_tokens", "symbol_tokens", "body_tokens")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(terms.value.count, np.int64)
        for batch in batches:
            held += np.bincount(terms.value.found(batch)[1], minlength=len(held))
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(held[some])], names=["term", "n"])

    n = np.zeros(len(patterns.dictionary))
    sums = read.mapInArrow(counted, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    n[sums.column("term").to_numpy()] = sums.column("n").to_numpy()
    idf = np.log((stats["docs"] - n + 0.5) / (n + 0.5), where=n > 0, out=np.zeros(len(n)))
    weights = spark.sparkContext.broadcast((asked, np.where(idf <= 0, LEAST_IDF, idf)))
    average, schema = stats["avgdl"], pa.schema([("asked", pa.int32()), ("doc", read.limit(0).toArrow().schema.field("doc").type), ("score", pa.float64())])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, idf = weights.value
        best, held, size = Best(len(asked), limit), [], 0

        def score() -> None:
            _scored(best, asked, len(idf), *map(np.concatenate, zip(*held)))
            held.clear()

        for batch in batches:
            row, term, tf = terms.value.found(batch)
            length = batch.column("n_tokens").to_numpy(zero_copy_only=False)[row]
            held.append((batch.column("doc").to_numpy(zero_copy_only=False), row + size, term, idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / average))))
            size += batch.num_rows
            if size >= BLOCK:
                score()
                size = 0
        if held:
            score()
        yield from best.batches(schema)

    near = read.mapInArrow(scored, f"asked int, doc {doc_type}, score double")
    order = Window.partitionBy("asked").orderBy(F.desc(F.round("score", 9)), "doc")
    top = near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)
    return top.join(F.broadcast(same), "asked").select("query_id", "doc", "score", "rank")  # a slice of the queries


def search_all(tokens: DataFrame, queries: DataFrame, limit: int = 50) -> DataFrame:
    """As :func:`search`, for a large query set: ``tokens`` are rows of :func:`indexed`, read twice a slice of at most ``MOST_TERMS`` terms.

    No pair of query and document is shuffled; of each task the ``limit`` best of each query are. ``query_id`` is unique, ``doc`` an integer.
    """
    phrases = query_phrases(queries).select("query_id", F.array_join("tokens", " ").alias("pattern"))
    stats, slices = corpus_stats(tokens).first(), max(1, -(-phrases.count() // MOST_TERMS))
    each = [phrases.filter(F.pmod(F.xxhash64("query_id"), F.lit(slices)) == k) if slices > 1 else phrases for k in range(slices)]
    return reduce(DataFrame.unionByName, [_search_slice(tokens, part, stats, limit) for part in each])
