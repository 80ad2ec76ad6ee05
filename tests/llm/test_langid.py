import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_cases import DOCS, documents

from walkweave.llm import langid

ENGLISH = ["the cat sat on the mat with the other cats", "this is what we think of when they were there", "a thing that the people would have done with this"]
GERMAN = ["der Hund und die Katze sind nicht im Haus", "ich habe das nicht gesehen und sie auch nicht", "wir gehen heute mit den Kindern in die Schule"]
RUSSIAN = ["это не то что мы думали", "когда они были там с нами", "кошка сидит на столе"]


def training(spark, copies=20):
    rows = [(i * 4 + k, t, lang) for i in range(copies) for lang, ts in (("en", ENGLISH), ("de", GERMAN), ("ru", RUSSIAN)) for k, t in enumerate(ts)]
    return spark.createDataFrame([(n, t, lang) for n, (_, t, lang) in enumerate(rows)], "doc_id bigint, text string, lang string")


@pytest.fixture(scope="module")
def model(spark):
    return langid.learn(training(spark))


def test_languages_of_texts(model):
    got = model.predict(["the other people were there", "und die Kinder nicht gesehen", "они думали о нас", None, "", "123 !?", "½ ²", "the"])
    assert [x for x, _ in got] == ["en", "de", "ru", "und", "und", "und", "und", "en"]
    assert all(0 <= s <= 1 for _, s in got) and [s for x, s in got if x == "und"] == [0] * 4


def test_spans_of_mixed_text(model):
    text = "The people would have done this with the other cats. Der Hund und die Katze sind nicht im Haus! Кошка сидит на столе."
    spans = model.spans(text)
    assert [x for x, _, _ in spans] == ["en", "de", "ru"]
    assert text[spans[1][1] : spans[1][2]].startswith("Der Hund") and text[spans[2][1] : spans[2][2]] == "Кошка сидит на столе"
    assert model.spans(None) == model.spans("1 2") == []


def test_scripts_narrow_candidates(model):
    scores = model.word_scores(["кошка", "cat", "日本"])
    en, de, ru = (model.languages.index(x) for x in ("en", "de", "ru"))
    assert scores[0, en] < -1e5 and scores[0, de] < -1e5 and scores[0, ru] == 0
    assert scores[1, ru] < -1e5 and (scores[2] > -1e5).all()


def plain_viterbi(scores, penalty):
    best = scores[0].astype(float)
    for row in scores[1:]:
        best = row + np.maximum(best, best.max() - penalty)
    return best.max()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 7), max_size=25), max_size=6), st.integers(0, 10**6))
def test_labelling_is_the_best(lists, seed):
    scores = np.random.default_rng(seed).normal(0, 4, (8, 3)).astype(np.float32)
    model = langid.Model(["a", "b", "c"], np.ones((3, 1 << 4)), np.ones((3, len(langid._NAMES))), 4, penalty=3.0)
    for sequence, labels in zip(lists, model.label([np.array(x, int) for x in lists], scores)):
        assert len(labels) == len(sequence)
        if sequence:
            got = sum(scores[w, k] for w, k in zip(sequence, labels)) - 3.0 * int((np.diff(labels) != 0).sum())
            assert abs(got - plain_viterbi(scores[sequence], 3.0)) < 1e-3


def test_rows(spark):
    docs = training(spark).union(documents(spark).selectExpr("doc_id + 10000 as doc_id", "text", "cast(null as string)"))
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    assert len(got) == docs.count()
    for i, t in DOCS:
        row = got[i + 10000]
        assert (row.lang_pred == "und") == (not any(c.isalpha() for c in t or "")) and 0 <= row.score <= 1
    import zlib

    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns and kept.where("doc_id IN (10001, 10002, 10003)").count() == 0


def test_nothing_to_learn(spark):
    none = documents(spark, lang=None)
    assert {r.lang_pred for r in langid.identify(none).collect()} == {"und"}
    assert langid.identify(documents(spark, [])).count() == 0


def test_held_out_rows_teach_nothing(spark):
    docs = training(spark)
    changed = docs.selectExpr("doc_id", "text", "CASE WHEN crc32(CAST(doc_id AS STRING)) % 4 = 2 THEN 'xx' ELSE lang END AS lang")
    assert {tuple(r) for r in langid.identify(docs).collect()} == {tuple(r) for r in langid.identify(changed).collect()}
