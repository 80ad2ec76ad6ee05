import random
import zlib

import numpy as np
import pytest
from llm_cases import DOCS, documents, words

from walkweave.llm import toxicity as T

BAD = ["grunk", "blarg", "snorfle"]


def tables(spark, n=600, wrong=0.0):
    rng = random.Random(2)
    docs, labels = [], []
    for i in range(n):
        toxic = rng.random() < 0.2
        text = words(1000 + i, 30).split()
        if toxic:
            word = rng.choice(BAD)
            text.insert(rng.randint(0, 30), word + (words(i, 1) if word == "grunk" else ""))
        docs.append((i, " ".join(text)))
        labels.append((i, 1, int(toxic != (rng.random() < wrong))))
    labels += [(1, 1, None), (None, 1, 1), (10**6, 1, 1)]
    return docs, documents(spark, docs), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


@pytest.mark.parametrize("wrong", [0.0, 0.03])
def test_held_out_texts(spark, wrong):
    docs, frame, labels = tables(spark, wrong=wrong)
    made = T.learn(frame, labels)
    assert any(v.startswith("grunk") for v in made.voters)
    got = {r.doc_id: r for r in T.score(frame, made).collect()}
    assert len(got) == len(docs)
    right = held = 0
    for i, text in docs:
        row = got[i]
        assert row.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and row.predicted == int(row.score >= 0.5) and 0 <= row.score <= 1
        if row.held_out:
            held += 1
            right += row.predicted == any(b in text for b in BAD)
    assert right / held > 0.97


def test_odd_rows(spark):
    _, frame, labels = tables(spark)
    made = T.learn(frame, labels)
    got = T.score(documents(spark, [*DOCS, DOCS[4]]), made).collect()
    assert len(got) == len(DOCS) + 1 and all(r.predicted == 0 for r in got)
    assert T.score(documents(spark, []), made).count() == 0


def test_nothing_to_learn(spark):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert {r.predicted for r in T.score(documents(spark), T.learn(documents(spark), none)).collect()} == {0}
    assert T.learn(documents(spark, []), none).voters == []


def test_held_out_labels_teach_nothing(spark):
    _, frame, labels = tables(spark)
    turned = labels.selectExpr("doc_id", "quality", "CASE WHEN crc32(CAST(doc_id AS STRING)) % 5 = 0 THEN 1 - toxic ELSE toxic END AS toxic")
    a, b = T.learn(frame, labels), T.learn(frame, turned)
    assert a.voters == b.voters and a.weights == b.weights


def test_label_model_finds_accuracies_and_correlations():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.3
    good = np.where(rng.random(4000) < 0.9, truth, ~truth)
    weak = np.where(rng.random(4000) < 0.6, truth, ~truth)
    model = T.LabelModel(np.column_stack((good, weak, weak)).astype(float), np.where(rng.random(4000) < 0.85, truth, ~truth).astype(float))
    assert model.accuracy[0] > 0.85 > model.accuracy[1]
    assert model.correlation[1, 2] > 0.9 and model.share[1] < model.share[0]
    assert ((model.posterior > 0.5) == truth).mean() > 0.85


def test_posterior_against_brute_force():
    """Bayes' rule over the groups' patterns, counted one by one from the model's own posterior."""
    rng = np.random.default_rng(5)
    truth = rng.random(300) < 0.3
    fires = np.column_stack([np.where(rng.random(300) < q, truth, ~truth) for q in (0.9, 0.8, 0.7)])
    fires = np.column_stack((fires, fires[:, 1], rng.random(300) < 0.1)).astype(float)
    labels = np.where(rng.random(300) < 0.9, truth, ~truth).astype(float)
    model = T.LabelModel(fires, labels, rounds=400)
    assert any({1, 3} <= set(g) for g in model.groups) and sorted(v for g in model.groups for v in g) == list(range(6))
    rows, post = [(*map(int, f), int(y)) for f, y in zip(fires, labels)], model.posterior.tolist()
    rate = (sum(post) + 1) / (len(post) + 2)
    for row, p in list(zip(rows, post))[:60]:
        toxic, clean = rate, 1 - rate
        for group in model.groups:
            same = [tuple(r[v] for v in group) == tuple(row[v] for v in group) for r in rows]
            toxic *= (sum(q for q, s in zip(post, same) if s) + 0.5) / (sum(post) + 0.5 * 2 ** len(group))
            clean *= (sum(1 - q for q, s in zip(post, same) if s) + 0.5) / (len(post) - sum(post) + 0.5 * 2 ** len(group))
        assert abs(toxic / (toxic + clean) - p) < 1e-3


def test_equal_texts_count_as_their_highest_label(spark):
    docs, _, labels = tables(spark)
    again = [(10_000 + i, t) for i, t in docs]
    frame = documents(spark, [*docs, *again])
    low = spark.createDataFrame([(10_000 + i, 1, 0) for i, _ in docs], "doc_id bigint, quality int, toxic int")
    found = [T.learn(f, n) for f, n in ((frame, labels.union(low)), (frame.orderBy("doc_id", ascending=False), low.union(labels)))]
    assert found[0].voters == found[1].voters and found[0].weights == found[1].weights
    assert any(v.startswith("grunk") for v in found[0].voters)


def test_finder_agrees_with_plain_search():
    finder = T.Finder(["abc", "abcd$", "x$", *T.PATTERNS])
    assert finder("Abcde abcd. X!!") == [0, 1, 2, 4] and finder("xy ab") == [] and finder(None) == []
    assert {T.PATTERNS[i - 3] for i in finder("you are sooooo d*mb, STOP!")} == {"#stretched", "#masked", "#shouted"}
    assert finder("AAAA BBBB CCCC DDDD EEEE FFFF") == [3]
