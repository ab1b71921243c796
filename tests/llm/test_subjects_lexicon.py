from __future__ import annotations

from test_subjects import AREAS, DOCS, LABELS, REPOS, corpus

from lodestone.llm import subjects as S


def test_a_lexicon_too_large_to_broadcast_is_joined_whole(spark, monkeypatch):
    docs, truth = corpus(160)
    docs += [(1001, "", None, None, None, None), (1002, " \n ", None, None, None, None), (1003, None, None, None, None, None)]
    labels = [(k, s, "a") for k in range(100) for s in truth[k]]
    frames = (spark.createDataFrame(docs, DOCS), spark.createDataFrame([("law", None), ("food", None), ("rare", None)], AREAS), spark.createDataFrame(labels, LABELS), spark.createDataFrame([], REPOS))

    def voted():
        return sorted(tuple(r) for r in S.votes(*frames).select("doc_id", "subject", "lexicon", "section", "raters").collect())

    whole = voted()
    assert len(whole) == 162 * 3 and {r[2] for r in whole} == {0, 1, 2}
    monkeypatch.setattr(S, "MOST_PAIRS", 5)
    monkeypatch.setattr(S, "AT_ONCE", 50, raising=False)
    assert voted() == whole
