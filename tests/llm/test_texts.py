from __future__ import annotations

import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import leakage, tokenize

RANKS = tokenize.read_ranks(tokenize.VOCABULARY)
PUBLIC = tiktoken.Encoding("public", pat_str=tokenize.PATTERN, mergeable_ranks=RANKS, special_tokens={})
ENCODER = tokenize.Encoder(RANKS)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=200))
def test_encoding_equals_the_public_one_and_round_trips(text):
    ids = ENCODER.encode(text)
    assert ids == PUBLIC.encode_ordinary(text)
    assert tokenize.decode(ids, RANKS) == text


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=1, max_size=300))
def test_both_ways_to_merge_agree(word):
    assert tokenize.merge_short(word, RANKS) == tokenize.merge_long(word, RANKS)


def test_encoding_of_a_table(spark):
    long = "x" * 30_000 + " the end" * 10_000
    rows = [(1, "", "t"), (2, None, "t"), (3, "<|endoftext|> 'll \u0000\t  x", "t"), (4, long, "t"), (4, long, "t"), (None, "a", "t")]
    got = [(r.doc_id, r.ids) for r in tokenize.encode(spark.createDataFrame(rows, "doc_id long, text string, ids string")).collect()]
    assert dict(got) == {d: PUBLIC.encode_ordinary(t or "") for d, t, _ in rows} and len(got) == 6
    assert tokenize.encode(spark.createDataFrame([], "doc_id long, text string")).count() == 0


W = [f"w{k}" for k in range(60)]
OPENING = "Read this with care and answer."
ITEMS = [(1, "What is w1 of w2?", f"{OPENING} {' '.join(W)}"), (2, None, f"{OPENING} {' '.join(f'v{k}' for k in range(40))}"), (3, "q", f"{OPENING} {' '.join(f'u{k}' for k in range(40))}"), (4, "only question", None), (5, None, "too short")]
ITEM_KIND = "item_id long, question string, text string, start int"
DOC_KIND = "doc_id long, text string, item_id long, kind string"


def found(spark, texts, items=ITEMS):
    docs = spark.createDataFrame([(k, t, 9, "x") for k, t in enumerate(texts)], DOC_KIND)
    rows = leakage.leaked_passages(docs, spark.createDataFrame([(*i, 0) for i in items], ITEM_KIND))
    return {(r.doc_id, r.item_id): (r.n_words, texts[r.doc_id][r.start : r.end]) for r in rows.filter("kind = 'passage'").collect()}


def edited(words, every, how):
    out = []
    for k, w in enumerate(words):
        if k % every == every - 1:
            out += {"replace": ["zzz"], "add": [w, "zzz"], "drop": []}[how]
        else:
            out.append(w)
    return " ".join(out)


def test_passages(spark):
    texts = [
        "before " + " ".join(W[10:22]) + " after", " ".join(W[10:21]), OPENING + " then nothing", None, "", "  ", "What is w1 of w2?",
        edited(W, 8, "replace"), edited(W, 9, "add"), edited(W, 9, "drop"), edited(W, 4, "replace"),
        "> **W3** w4\n> <b>w5</b>, w6&nbsp;w7\n * w8; w9 – w10!\n// W11 w12 `w13` w14", "x " * 20_000 + " ".join(W[:12]), " ".join(W[20:26] + ["zzz"] + W[27:34]),
    ]
    got = found(spark, texts)
    assert set(got) == {(k, 1) for k in (0, 7, 8, 9, 11, 12, 13)}
    assert got[0, 1] == (12, " ".join(W[10:22])) and got[11, 1][1].startswith("W3** w4") and got[11, 1][1].endswith("w14")
    assert got[7, 1][0] >= 50 and got[8, 1][0] == 60 and got[9, 1][0] >= 52 and got[13, 1][0] == 13


def test_comments_interrupt_nothing_and_are_read_themselves(spark):
    long = "filler " * 3_000
    texts = [" ".join(W[:8]) + f" <!-- {long} --> " + " ".join(W[8:16]), f"a <!-- {long}" + " ".join(W[:12]) + " --> b", f"<!-- {' '.join(W[:8])} --> <!-- {' '.join(W[8:16])} -->", "<!-- " * 50_000]
    got = found(spark, texts)
    assert set(got) == {(0, 1), (1, 1)} and got[1, 1] == (12, " ".join(W[:12])) and got[0, 1][0] == 16


def test_items_of_any_number_are_cut_into_blocks(spark):
    docs = spark.createDataFrame([(1, " ".join(W), 0, "x"), (2, " ".join(f"v{k}" for k in range(20)) + " " + " ".join(W[:15]), 0, "x")], DOC_KIND)
    items = spark.createDataFrame([(*i, 0) for i in ITEMS], ITEM_KIND)
    take = lambda df: sorted(tuple(r) for r in df.collect())
    one = take(leakage.leaked_passages(docs, items))
    assert take(leakage.leaked_passages(docs, items, block_bytes=200)) == one and len(one) == 3


def test_repeated_rows_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, " ".join(W), 0, "x")] * 3, DOC_KIND)
    items = spark.createDataFrame([(*i, 0) for i in ITEMS] * 2, ITEM_KIND)
    assert leakage.leaked_passages(docs, items).count() == 1
    assert leakage.leaked_passages(docs, items.limit(0)).count() == leakage.leaked_passages(docs.limit(0), items).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["a", "b<c", "<b>", "</b>", "&amp;", "&#x41;", "x-\ny", "\n> ", "é", "\u00ad"]), max_size=20))
def test_places_of_words(parts):
    text = " ".join(parts)
    words, places = leakage.words(text, True)
    assert len(words) == len(places)
    assert all(0 <= a < b <= len(text) for a, b in places) and places == sorted(places)


def test_scanners_stay_linear_on_odd_texts():
    """Long runs of opening signs, which a careless pattern would scan again and again."""
    from lodestone.llm import credentials, generated, subjects

    scanner = leakage.Scanner([(1, None, " ".join(W))])
    for text in ("/*" * 50_000, "<!--" * 50_000, "\n" * 100_000, "a." * 50_000, "key" * 50_000, "`" * 100_000, "'" * 100_000):
        assert scanner.scan(text) == [] and credentials.find(text, "a.env") == []
        assert generated.notice(text)[0] is None and len(generated.statistics(text, "a.ts")) == len(generated.FEATURES) - 1
        subjects.paragraphs(text)
