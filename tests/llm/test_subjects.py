from __future__ import annotations

import random

import numpy as np

from lodestone.llm import subjects as S

WORDS = {"law": ["court order", "judge ruling", "contract clause", "legal notice", "appeal deadline"], "food": ["oven heat", "bread dough", "soup stock", "kitchen timer", "salad bowl"]}
FILLER = ["See the guide before you open a change.", "This page was moved from the old wiki.", "Names are sorted, then written to disk."]
AREAS = "subject string, description string"
DOCS = "doc_id long, text string, source string, path string, subject string, posterior double"
LABELS = "doc_id long, subject string, rater string"
REPOS = "repo string, subject string"


def paragraph(rng, subject):
    return " ".join(f"We read the {rng.choice(WORDS[subject])} once per hour with {rng.choice(WORDS[subject])}." for _ in range(4))


def corpus(n, seed=1):
    rng = random.Random(seed)
    docs, truth = [], {}
    for k in range(n):
        own = {s for s in WORDS if rng.random() < 0.45}
        parts = [paragraph(rng, s) for s in sorted(own)] + [" ".join(rng.sample(FILLER, 2))]
        if rng.random() < 0.3:
            parts.append(f"{FILLER[0]} The example with the {rng.choice(WORDS['food'])} was taken out. {FILLER[1]}")
        parts.append("```\nconst court order = judge ruling\n```")
        docs.append((k, "\n\n".join(parts), "s", "p", None, None))
        truth[k] = own
    return docs, truth


def assign(spark, docs, labels, repos=()):
    frames = (spark.createDataFrame(docs, DOCS), spark.createDataFrame([("law", "courts"), ("food", None), (None, "x")], AREAS), spark.createDataFrame(labels, LABELS), spark.createDataFrame(list(repos), REPOS))
    return {(r.doc_id, r.subject) for r in S.assigned(*frames).collect()}


def test_held_out_documents(spark):
    docs, truth = corpus(240)
    labels = [(k, s, "a") for k in range(120) for s in truth[k]] * 2 + [(3, "unknown", "b"), (None, "law", "b"), (9999, "law", "b"), (5, None, "b")]
    wrong = next(k for k in range(120) if truth[k] == {"law"})
    labels.append((wrong, "food", "b"))
    extra = [(1000, None, None, None, None, None), (1001, "", None, None, None, None), (1002, " \n ", None, None, None, None), (0, docs[0][1], "s", "p", None, None), (1003, "x " * 60_000, "s", "p", None, None), (None, "court order", "s", "p", None, None)]
    got = assign(spark, docs + extra, labels, [("meadow", "law"), (None, "law"), ("x", None)])
    true = {(k, s) for k in range(120, 240) for s in truth[k]}
    held = {(k, s) for k, s in got if 120 <= k < 240}
    assert len(held & true) >= 0.95 * len(true) and len(held - true) <= 0.03 * len(true)
    assert not {k for k, _ in got if k >= 1000}


def test_empty_tables(spark):
    docs, truth = corpus(10)
    assert assign(spark, docs, []) == set()
    assert assign(spark, [], [(1, "law", "a")]) == set()


def test_accuracies_are_learned():
    rng = np.random.default_rng(4)
    y = rng.random(5000) < 0.3
    vote = lambda right: np.where(rng.random(5000) < right, y, ~y)
    lexical = np.where(vote(0.97), 2, 0)
    rated = np.where(rng.random(5000) < 0.2, np.where(vote(0.9), 2, 1), 0)
    patterns, inverse, counts = np.unique(np.stack([lexical, lexical, np.zeros(5000, int), np.zeros(5000, int), rated], 1), axis=0, return_inverse=True, return_counts=True)
    post = S.fit(patterns, counts.astype(float))[inverse.ravel()]
    assert ((post >= 0.5) == y).mean() > 0.95
    assert len(S.fit(np.zeros((0, 5), int), np.zeros(0))) == 0


def test_paragraphs_leave_out_code_logs_and_markup():
    text = "# Title here now\n\n```ts\nconst a = b c d\n```\n\n2025-01-01 WARN one two three\n\n * A `unitTest` fails often. Ok.\n"
    flat = [s for part in S.paragraphs(text) for s in part]
    assert len(flat) == 2 and S._pair("unit", "test") in flat[1] and S._pair("warn", "one") not in {p for s in flat for p in s}


def test_sections_use_the_words_of_the_descriptions():
    own = S.own_words([("law", "courts, contracts, statutes"), ("food", "kitchens, recipes with contracts")])
    assert own == {"court": 0, "statute": 0, "kitchen": 1, "recipe": 1, "food": 1}
    text = "# The courts of appeal\n\nIn the kitchen we read a lot. It was moved again.\n\nTwo recipes were lost today. No kitchen was open then."
    assert S.described(text, S.split(text), own, 2) == [2, 2] and S.described("", [], own, 2) == [0, 0]
    assert S.described("x", S.split("In the kitchen we read a lot. It was moved again."), own, 2) == [0, 0]


def test_the_path_is_an_address_too(spark):
    docs = [(1, "no name here at all", "s", "docs/meadow/x.md", None, None), (2, "# meadow-two\n\nwords of some kind", "s", "docs/meadow/x.md", None, None), (3, "nothing of this sort", "s", None, None, None)]
    frames = (spark.createDataFrame(docs, DOCS), spark.createDataFrame([("law", ""), ("food", "")], AREAS), spark.createDataFrame([], LABELS), spark.createDataFrame([("Meadow", "law"), ("meadow-two", "food")], REPOS))
    got = {(r.doc_id, r.subject): r.address for r in S.votes(*frames).collect()}
    assert got == {(1, "law"): 2, (1, "food"): 1, (2, "law"): 1, (2, "food"): 2, (3, "law"): 0, (3, "food"): 0}


def test_composition(spark):
    out = S.composition(spark.createDataFrame([(1, "law"), (2, "law"), (2, "food")], "doc_id long, subject string"), spark.createDataFrame([(1,), (2,), (3,), (3,)], "doc_id long"))
    assert {r.subject: (r.documents, r.share) for r in out.collect()} == {"law": (2, 0.666667), "food": (1, 0.333333)}
