import random

import pytest
from llm_cases import DOCS, documents, words

import corpus_pipeline
from walkweave.llm import shingles, simhash


def shingle_set(text):
    found = (text or "").encode().lower().split()
    return {tuple(found[i : i + 5]) for i in range(max(1, len(found) - 4))}


def kept_by_brute_force(rows):
    sets = [shingle_set(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                group = [group[j] if g == group[i] else g for g in group]
    return {min(i for (i, _), x in zip(rows, group) if x == g) for g in set(group)}


def edited(rng, text, n):
    found = text.split()
    for i in rng.sample(range(len(found)), n):
        found[i] = f"new{rng.random()}"
    return " ".join(found)


def cases():
    rng, rows = random.Random(3), list(DOCS)
    for i in range(60):  # similarities on both sides of the bound, and chains
        text = words(1000 + i, 150)
        rows.append((100 + 4 * i, text))
        for k in range(1, 4):
            text = edited(rng, text, k)
            rows.append((100 + 4 * i + k, text))
    return rows


@pytest.mark.parametrize("chunk", [512, 2])
def test_keep_one(spark, chunk):
    rows = cases()
    got = shingles.keep_one(documents(spark, rows), chunk=chunk).collect()
    assert sorted(r.doc_id for r in got) == sorted(kept_by_brute_force(rows))
    assert shingles.keep_one(documents(spark, [])).count() == 0


def test_stage_of_the_pipeline(spark):
    rows = cases()
    got = corpus_pipeline.near_duplicates(spark, documents(spark, rows), "").collect()
    assert {r.doc_id for r in got} == kept_by_brute_force(rows)


def test_simhash_finds_close_texts_without_bands(spark):
    """Fingerprints within 3 bits make candidates by themselves: one band of very many minima finds none of these."""
    rng, rows = random.Random(5), []
    for i in range(20):
        text = words(3000 + i, 900)
        rows.append((10 * i, text))
        rows += [(10 * i + k, edited(rng, text, k)) for k in (1, 2)]
    prints = {i: simhash.majority(shingles.shingles(t.encode())) for i, t in rows}
    near = [(i, j) for i in prints for j in prints if i < j and (prints[i] ^ prints[j]).bit_count() <= 3]
    assert 10 < len(near) < 60
    sets = {i: shingle_set(t) for i, t in rows}
    assert all(5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) for i, j in near)
    group = {i: i for i in prints}
    for i, j in near:
        group = {k: group[i] if g == group[j] else g for k, g in group.items()}
    got = shingles.keep_one(documents(spark, rows), bands=1, rows=4000).collect()
    assert {r.doc_id for r in got} == {min(k for k in group if group[k] == g) for g in set(group.values())}


def test_links_of_close_prints(spark):
    """Every two prints within 3 bits, equal ones included, are joined by the links, and no others are linked."""
    rng, prints = random.Random(6), []
    for _ in range(40):
        own = rng.getrandbits(64)
        prints += [own, own] + [own ^ sum(1 << b for b in rng.sample(range(64), n)) for n in (1, 3, 4)]
    rows = [(h, simhash._signed(fp)) for h, fp in enumerate(prints)]
    got = shingles.close_prints(spark.createDataFrame(rows, "h bigint, fp bigint"), 3, 5).collect()
    assert all((prints[r.a] ^ prints[r.b]).bit_count() <= 3 for r in got)

    def groups(links):
        group = list(range(len(prints)))
        for a, b in links:
            group = [group[a] if g == group[b] else g for g in group]
        return {frozenset(i for i, x in enumerate(group) if x == g) for g in set(group)}

    close = [(a, b) for a in range(len(prints)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 3]
    assert groups((r.a, r.b) for r in got) == groups(close)
