import random

import numpy as np
import pytest
from graphs import CHAIN, LOOP, PREFIX, ROOTS, full, graph, roots

from walkweave.graph import entity_frame
from walkweave.operators.community import communities, modularity
from walkweave.operators.ids import dense_ids
from walkweave.operators.literals import features, literals
from walkweave.plans.embedders import FastText, Word2Vec
from walkweave.plans.pipeline import WalkEmbedding, upsert
from walkweave.operators.samplers import ObjFreqSampler
from walkweave.plans.walkers import AnonymousWalker, NGramWalker, RandomWalker, SplitWalker, WalkletWalker
from walkweave.streaming.upsert import current, follow


def vectors(df):
    return {r.entity: list(r.vector) for r in df.collect()}


def test_fit_and_transform(spark):
    kg = graph(spark, LOOP, literals=[[PREFIX + "knows"]])
    found = []
    for _ in range(2):
        made = WalkEmbedding(Word2Vec(vector_size=5, seed=1), [RandomWalker(2), WalkletWalker(1)])
        embedded, values = made.fit_transform(kg, roots(spark))
        found.append(vectors(embedded))
    assert found[0] == found[1] and set(found[0]) == set(ROOTS)
    assert {r.entity: r.kind for r in values.collect()} == dict(zip(ROOTS, ["tuple", "scalar", "none"]))
    assert {r.walker_idx for r in made.walk_store.collect()} == {0, 1}


def test_unknown_entities(spark):
    kg = graph(spark, LOOP)
    with pytest.raises(ValueError):
        WalkEmbedding().fit(kg, entity_frame(spark, ["nobody"]))
    made = WalkEmbedding(Word2Vec(vector_size=4), [RandomWalker(1)]).fit(kg, roots(spark))
    with pytest.raises(ValueError):
        made.embedder.transform(entity_frame(spark, ["nobody"]))
    with pytest.raises(ValueError):
        Word2Vec().vectors()


def test_update_save_and_load(spark, tmp_path):
    kg = graph(spark, CHAIN)
    made = WalkEmbedding(Word2Vec(vector_size=4, seed=1), [RandomWalker(1)])
    made.fit_transform(kg, roots(spark))
    made.save(str(tmp_path / "m"))
    again = WalkEmbedding.load(spark, str(tmp_path / "m"), Word2Vec(vector_size=4, seed=1), [RandomWalker(1)])
    more = entity_frame(spark, full("Emma", "Alice"))
    again.fit_transform(kg, more, is_update=True)
    assert {r.entity for r in again.walk_store.collect()} == {*ROOTS, PREFIX + "Emma"}
    assert again.embeddings.count() == 4 and again.walk_store.where(f"entity = '{PREFIX}Alice'").count() == 2
    with pytest.raises(ValueError):
        WalkEmbedding.load(spark, str(tmp_path / "none"))


def test_saving_where_it_was_loaded(spark, tmp_path):
    kg, path = graph(spark, CHAIN), str(tmp_path / "m")
    walkers = [NGramWalker(2, None, ObjFreqSampler(inverse=True), grams=2, wildcards=[1]), SplitWalker(1, func_split=sorted)]
    made = WalkEmbedding(FastText(vector_size=4, epochs=1, seed=1), [RandomWalker(1, 2, with_reverse=True), *walkers])
    first = vectors(made.fit_transform(kg, roots(spark))[0])
    made.save(path)
    again = WalkEmbedding.load(spark, path)
    assert vectors(again.embedder.transform(roots(spark))) == first
    assert [type(w) for w in again.walkers] == [type(w) for w in made.walkers] and again.walkers[0].with_reverse
    assert again.walkers[1].sampler.inverse and again.walkers[1].wildcards == [1] and again.walkers[2].func_split is sorted
    again.fit_transform(kg, entity_frame(spark, full("Emma", "Alice")), is_update=True)
    again.save(path)
    assert again.embeddings.count() == 4  # what it holds reads the new version
    third = WalkEmbedding.load(spark, path)
    assert third.embeddings.count() == 4 and sorted(map(str, third.walk_store.collect())) == sorted(map(str, again.walk_store.collect()))
    assert [p.name for p in (tmp_path / "m").iterdir()] == ["v000002"]
    third.walkers.append(SplitWalker(1, func_split=lambda names: names))
    with pytest.raises(ValueError):
        third.save(path)  # no module has that function by a name
    assert WalkEmbedding.load(spark, path).embeddings.count() == 4


def test_fasttext(spark):
    kg = graph(spark, LOOP)
    walks = AnonymousWalker(2).extract(kg, roots(spark))
    made = FastText(vector_size=4, epochs=2, seed=3).fit(walks)
    assert vectors(made.transform(roots(spark))) == vectors(FastText(vector_size=4, epochs=2, seed=3).fit(walks).transform(roots(spark)))
    new = vectors(made.transform(entity_frame(spark, [PREFIX + "Nobody", "strange"])))
    assert np.any(new[PREFIX + "Nobody"]) and not np.any(new["strange"])
    made.fit(AnonymousWalker(1).extract(kg, roots(spark)), is_update=True)
    own = FastText(vector_size=4, epochs=1, bucket=50, func_computing_ngrams=lambda name: list(name)).fit(walks)
    assert len(vectors(own.transform(entity_frame(spark, ["xyz"])))["xyz"]) == 4


def test_upsert(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3)], "entity string, x int")
    new = spark.createDataFrame([("b", 4), ("c", 5)], "entity string, x int")
    assert sorted(tuple(r) for r in upsert(old, new).collect()) == [("a", 1), ("b", 4), ("c", 5)]


def test_stream(spark, tmp_path):
    kg = graph(spark, CHAIN)
    roots(spark).write.parquet(str(tmp_path / "in"))
    entities = spark.readStream.schema("pos bigint, entity string").parquet(str(tmp_path / "in"))
    for _ in range(2):
        follow(entities, lambda batch: RandomWalker(1).extract(kg, batch), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
        entity_frame(spark, full("Emma", "Alice")).write.mode("append").parquet(str(tmp_path / "in"))
    store = current(spark.read.parquet(str(tmp_path / "out")))
    assert {r.entity for r in store.collect()} == {*ROOTS, PREFIX + "Emma"}
    assert store.where(f"entity = '{PREFIX}Alice'").count() == 2


def test_literal_chains_and_features(spark):
    rows = [("a", "p", "b"), ("a", "p", "c"), ("b", "v", "1"), ("c", "v", "3"), ("c", "v", "x")]
    found = literals(graph(spark, rows), entity_frame(spark, ["a", "z", "a"]), [["p", "v"], []])
    got = {(r.pos, r.chain_idx): (r.kind, [tuple(v) for v in r["values"]]) for r in found.collect()}
    assert got[(0, 0)] == got[(2, 0)] == ("tuple", [(1.0, None), (3.0, None), (None, "x")])
    assert got[(1, 0)] == ("none", []) and got[(1, 1)] == ("scalar", [(None, "z")])
    row = features(found).where("pos = 0 AND chain_idx = 0").first()
    assert (row.n, row.has_any, row.least, row.greatest, row.total, row.mean, row.spread) == (3, True, 1, 3, 4, 2, 1)


def test_communities(spark):
    clique = lambda name, n: [(f"{name}{i}", "p", f"{name}{j}") for i in range(n) for j in range(i)]
    rows = [*clique("a", 6), *clique("b", 5), ("a0", "p", "b0"), ("z", "p", "z")]
    kg = graph(spark, rows)
    found = communities(kg)
    of = {r.v: r.community for r in found.collect()}
    assert len({of[f"a{i}"] for i in range(6)}) == len({of[f"b{i}"] for i in range(5)}) == 1 and of["a1"] != of["b1"]
    assert modularity(kg, found) > 0.4
    alone = communities(graph(spark, []).add_vertices(spark.createDataFrame([("x",), ("y",)], "v string")))
    assert len({r.community for r in alone.collect()}) == 2


@pytest.mark.parametrize("resolution", [1.0, 4.0])
def test_communities_of_a_planted_graph(spark, resolution):
    rng = random.Random(1)
    of = {f"n{i}": i % 8 for i in range(160)}
    names = sorted(of)
    rows = [(a, "p", b) for i, a in enumerate(names) for b in names[:i] if rng.random() < (0.5 if of[a] == of[b] else 0.01)]
    kg = graph(spark, rows)
    planted = spark.createDataFrame([(v, str(c)) for v, c in of.items()], "v string, community string")
    found = communities(kg, resolution)
    assert found.count() == 160
    assert modularity(kg, found, resolution) > 0.95 * modularity(kg, planted, resolution)


def rows_dealt(spark):
    """Rows that all stages so far have written for others."""
    double = spark.sparkContext._gateway.jvm.double
    stages = spark._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(double, 0), None).iterator()
    total = 0
    while stages.hasNext():
        total += stages.next().shuffleWriteRecords()
    return total


def test_a_round_of_moves_deals_links_of_half_of_the_nodes(spark):
    """Two more rounds: each node's links are dealt once with their communities, and once by node."""
    rng = random.Random(2)
    links = {(i, rng.randrange(i)) for i in range(1, 200) for _ in range(12)}
    kg = graph(spark, [(f"n{a}", "p", f"n{b}") for a, b in sorted(links)])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        dealt = []
        for rounds in (1, 3):
            before = rows_dealt(spark)
            communities(kg, rounds=rounds, levels=1).collect()
            dealt.append(rows_dealt(spark) - before)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert dealt[1] - dealt[0] < 2 * 2 * len(links) + 2 * 12 * 200


def test_dense_ids(spark):
    names = [f"n{i:04}" for i in range(500)]
    got = dense_ids(spark.createDataFrame([(n,) for n in reversed(names)], "name string").repartition(7), ["name"]).collect()
    assert sorted((r.id, r.name) for r in got) == list(enumerate(names))
