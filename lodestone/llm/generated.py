"""Files that were not written by hand in their repository: generated, minified, copied, data.

A random forest decides on every file by statistics of its text (compression ratio, token entropy,
identifier lengths, comment density and shapes derived from them), by its path and by how much of it
stands in other repositories too. Its labels are the notices at the head of files ("code generated
by", "licensed copy of"; in formats without comments the leading keys by which lock files and source
maps name themselves). Notices are cut away before the statistics are taken, so the forest learns
what such files look like without them, and they decide nothing: a file, labelled or not, is found by
the score of a forest that has not seen it. Files without a label are unlabelled rather than
negative: in each round the files that score like labelled ones are set aside or, when they score
as high, join the labelled, before the last forests are fitted; scores are calibrated by the mean of the labelled files.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.sources.tables import checkpoint

LABELLED = 20_000
TREES, DEPTH = 40, 8
THRESHOLD = 0.4
LEAST_FILES = 3
SET_ASIDE = 0.1
LEAST_BLOCK = 60
LEAST_DATA, MOST_LETTERS = 400, 0.4

_HEAD = re.compile(r"(?:\s*(?:/\*.*?\*/|//[^\n]*|<!--.*?-->|#(?!!)[^\n]*|#![^\n]*|;[^\n]*|--[^\n]*))+", re.S)
#: How notices say that a file is made by a tool or copied.
_MADE = re.compile(
    r"@generated\b|<auto-?generated|\bauto-?generated\b|\bautomatically (?:generated|created|produced)\b|\b(?:code|file|module) (?:is |was )?generated\b|\bgenerated (?:by|from|with|using)\b"
    r"|\bdo not (?:edit|modify)\b|\bmachine[- ]generated\b|\bis the output of\b|\bproduced by\b.*\b(?:tool|compiler|generator)\b|SignedSource<<|\bchanges are lost\b|\bwill be overwritten\b"
    r"|\bmaschinell (?:erzeugt|erstellt)|\bautomatisch (?:erzeugt|generiert)|\bgénéré(?:e)? automatiquement|\bgenerado automáticamente|\bne pas modifier\b|\bno editar\b|\bnicht (?:von hand )?ändern\b",
    re.I,
)
_COPIED = re.compile(
    r"@license\b|@preserve\b|\bcopied from\b|\bvendored\b|\bupstream\b|\bthird[- ]party\b|\(c\) the [\w -]+ authors|\bpermission is (?:hereby )?granted\b|^\s*(?:/\*!?|//|\*)\s*[\w@./-]+ v?\d+\.\d+(?:\.\d+)?\b(?:[^\n]*\b(?:MIT|BSD|Apache|ISC|GPL|licen[cs]e)\b)?",
    re.I | re.M,
)
_NOT = re.compile(r"\bnot (?:auto-?)?generated\b|\bhand-?written\b|\bwritten by hand\b", re.I)
#: The leading keys of formats without comments that say a tool wrote them.
_LEADING = re.compile(r"\s*\{\s*(?:\"(?:name|version|requires|_comment|sources|file|sourceRoot|names)\"\s*:\s*(?:\"[^\"]*\"|\[[^\[\]{}]*\]|[\w.]+)\s*,\s*)*(\"lockfileVersion\"\s*:\s*\d+\s*,?|\"mappings\"\s*:)")
_FOREIGN = re.compile(r"(?:^|/)(?:node_modules|bower_components|vendor|third[_-]party|thirdparty|deps|externals?|site-packages)/", re.I)
_MADE_PATH = re.compile(r"\.min\.\w+$|\.bundle\.\w+$|[.-][0-9a-f]{8,}\.\w+$|\.map(?:\.json)?$|(?:package-lock|npm-shrinkwrap|composer\.lock|yarn\.lock|pnpm-lock)[\w.]*$|_pb2?(?:_grpc)?\.\w+$|\.(?:generated|gen|g|designer)\.\w+$", re.I)
_TOKEN = re.compile(r"[A-Za-z_$][\w$]*|\d[\w.]*|'(?:[^'\\\n]|\\.)*'|\"(?:[^\"\\\n]|\\.)*\"|[^\s\w]")
_COMMENT = re.compile(r"/\*.*?\*/|(?<![:'\"\w\\])//[^\n]*|^[ \t]*#[^\n]*", re.S | re.M)
_LINE_COMMENT = re.compile(r"(?<![:'\"\w\\])//[^\n]*|^[ \t]*#[^\n]*", re.M)
_SHAPE = re.compile(r"'(?:[^'\\\n]|\\.)*'|\"(?:[^\"\\\n]|\\.)*\"|[A-Za-z_$][\w$]*|\d[\w.]*")
_LITERALS = re.compile(r"'(?:[^'\\\n]|\\.)*'|\"(?:[^\"\\\n]|\\.)*\"|`(?:[^`\\]|\\.)*`|(?<![\w$])-?\d[\w.]*", re.S)
_STATEMENT = re.compile(r"\b(?:function|class|if|for|while|return|switch|def|interface|type|enum|func|fn|void)\b|=>")
FEATURES = ("ratio", "entropy", "identifier", "short_names", "comments", "line_mean", "line_max", "digits", "literals", "distinct", "repeated", "blank", "letters", "foreign_path", "made_path", "shared")


def notice(code: str) -> tuple[str | None, str]:
    """``made`` or ``copied`` by the comments, or in JSON by the leading keys, at a file's head, and the code without them."""
    m = _HEAD.match(code)
    if not m:
        keys = _LEADING.match(code)
        return ("made", "{" + code[keys.end() :]) if keys else (None, code)
    head, rest = m.group(), code[m.end() :]
    kind = None
    for line in re.split(r"\n(?=\s*(?://|#|/\*))", head):
        if _NOT.search(line):
            continue
        if _MADE.search(line):
            kind = "made"
            break
        if _COPIED.search(line):
            kind = kind or "copied"
    return kind, rest


def _bare(code: str) -> str:
    """A text without its comments; block comments are looked for only as far as one ends."""
    last = code.rfind("*/") + 2 if "*/" in code else 0
    return _COMMENT.sub("", code[:last]) + _LINE_COMMENT.sub("", code[last:])


def data_only(bare: str, path: str) -> bool:
    """Whether a text (without comments) saved as source has no statement and is almost all literals; the label of files that no tool gives a notice."""
    if path.rsplit(".", 1)[-1].lower() not in ("ts", "mts", "cts", "tsx", "js", "mjs", "cjs", "jsx", "py", "rb", "go", "java", "c", "h", "cpp", "rs", "php"):
        return False
    solid = len(re.sub(r"\s", "", bare))
    if solid < LEAST_DATA or _STATEMENT.search(left := _LITERALS.sub("", bare)):
        return False
    return len(re.findall(r"[^\W\d_]", left)) < MOST_LETTERS * solid


def statistics(code: str, path: str, bare: str | None = None) -> list[float]:
    """The features of a text whose notice is cut away, all but the last (``shared``); its size is none of them. ``bare``: the text without comments."""
    raw = code.encode()
    n = max(1, len(code))
    bare = _bare(code) if bare is None else bare
    comments = len(code) - len(bare)
    tokens = _TOKEN.findall(bare)
    counts = Counter(tokens)
    total = max(1, len(tokens))
    entropy = -sum(c / total * math.log2(c / total) for c in counts.values())
    names = [t for t in tokens if t[0].isalpha() or t[0] in "_$"]
    lines = [x for x in bare.split("\n") if x.strip()]
    shapes = Counter(_SHAPE.sub("w", x.strip()) for x in lines)
    literal = sum(len(t) for t in tokens if t[0] in "'\"" or t[0].isdigit())
    lengths = [len(x) for x in lines] or [0]
    return [
        len(raw) / max(1, len(zlib.compress(raw, 6))),
        entropy / math.log2(total + 1),
        sum(map(len, names)) / max(1, len(names)),
        sum(len(t) < 3 for t in names) / max(1, len(names)),
        comments / n,
        math.log1p(sum(lengths) / len(lengths)),
        math.log1p(max(lengths)),
        sum(map(str.isdigit, code)) / n,
        literal / n,
        len(counts) / total,
        sum(c for c in shapes.values() if c > 2) / max(1, len(lines)),
        1 - len(re.sub(r"\s", "", code)) / n,
        sum(map(str.isalpha, code)) / n,
        float(bool(_FOREIGN.search(path))),
        float(bool(_MADE_PATH.search(path))),
    ]


def blocks(bare: str) -> list[int]:
    """Hashes of the paragraphs of a text without comments, white space aside; short ones are left out."""
    parts = (re.sub(r"\s+", " ", p).strip() for p in re.split(r"\n[ \t]*\n", bare))
    return sorted({xxhash.xxh64_intdigest(p) - (1 << 63) for p in parts if len(p) >= LEAST_BLOCK})


def described(files: DataFrame) -> DataFrame:
    """``file_id, repo, notice, features, blocks`` of every file with code, once each; ``notice`` is the label (made, copied, data) or null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            notices, features, hashes = [], [], []
            for path, code in zip(batch.column("path").to_pylist(), batch.column("code").to_pylist()):
                kind, rest = notice(code.removeprefix("﻿").replace("\r\n", "\n"))
                bare = _bare(rest)
                notices.append(kind or ("data" if data_only(bare, path or "") else None))
                features.append(statistics(rest, path or "", bare))
                hashes.append(blocks(bare))
            yield pa.RecordBatch.from_arrays(
                [batch.column("file_id"), batch.column("repo"), pa.array(notices, pa.string()), pa.array(features, pa.list_(pa.float64())), pa.array(hashes, pa.list_(pa.int64()))],
                ["file_id", "repo", "notice", "features", "blocks"],
            )

    rows = files.filter("code is not null and file_id is not null").select(F.col("file_id").cast("long"), "repo", "path", "code")
    return rows.mapInArrow(run, "file_id long, repo string, notice string, features array<double>, blocks array<long>").dropDuplicates(["file_id"])


def shared_blocks(files: DataFrame) -> DataFrame:
    """``file_id, shared``: the share of a file's blocks that also stand in another repository."""
    each = files.select("file_id", "repo", F.explode("blocks").alias("block"))
    spread = each.groupBy("block").agg(F.min("repo").alias("a"), F.max("repo").alias("b")).filter("a <> b").select("block", F.lit(1.0).alias("elsewhere"))
    return each.join(spread, "block", "left").groupBy("file_id").agg(F.avg(F.coalesce("elsewhere", F.lit(0.0))).alias("shared"))


def scored(files: DataFrame, labelled: int = LABELLED, trees: int = TREES, depth: int = DEPTH) -> DataFrame:
    """``file_id, notice, score``: how like files with a notice each file is, 1 being as like as they are.

    The forest is fitted on at most ``labelled`` files with and as many without a notice, drawn by
    the hash of their id; every file is scored. Without two classes to learn from, or any file,
    files with a label score 1 and all others 0. Null code is left out, repeated rows count once.
    """
    facts = checkpoint(described(files))
    whole = facts.join(shared_blocks(facts), "file_id", "left").select("file_id", "notice", F.concat("features", F.array(F.coalesce("shared", F.lit(0.0)))).alias("features"))
    full = checkpoint(whole).select("file_id", "notice", array_to_vector("features").alias("features"), F.col("notice").isNotNull().cast("double").alias("label"))
    sizes = {r["label"]: r["n"] for r in full.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return full.select("file_id", "notice", "label").withColumnRenamed("label", "score")
    share = F.create_map(*[x for label, n in sizes.items() for x in (F.lit(label), F.lit(min(1.0, labelled / n)))])
    drawn = F.pmod(F.xxhash64("file_id"), F.lit(1_000_000)) < share[F.col("label")] * 1_000_000
    training = full.filter(drawn)
    forest = RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=trees, maxDepth=depth, minInstancesPerNode=LEAST_FILES, featureSubsetStrategy="sqrt", seed=7, subsamplingRate=0.8, maxMemoryInMB=128)

    def calibrated(training: DataFrame, rated: DataFrame) -> DataFrame:
        raw = forest.fit(training).transform(rated).withColumn("p", vector_to_array("probability")[1])
        usual = raw.filter("notice is not null").agg(F.avg("p").alias("usual")).first()["usual"]
        return raw.select("file_id", "notice", F.least(F.lit(1.0), F.col("p") / F.lit(max(usual or 0.0, 1e-9))).alias("score"))

    # each half of the files is rated by a forest that has not seen it
    half = F.pmod(F.xxhash64("file_id", F.lit("half")), F.lit(2))

    def crossed(training: DataFrame, rated: DataFrame) -> DataFrame:
        parts = [training.filter(half == k) for k in (0, 1)]
        if any(p.select("label").distinct().count() < 2 for p in parts):
            return calibrated(training, rated)
        return calibrated(parts[0], rated.filter(half == 1)).unionByName(calibrated(parts[1], rated.filter(half == 0)))

    doubtful = crossed(training, training).filter(F.col("notice").isNull() & (F.col("score") >= SET_ASIDE)).select("file_id")
    last = crossed(checkpoint(training.join(doubtful, "file_id", "left_anti")), full)
    return last.select("file_id", "notice", "score")


def not_by_hand(files: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``file_id, notice, score`` of the files that were not written by hand in their repository."""
    return scored(files).filter(F.col("score") >= threshold)
