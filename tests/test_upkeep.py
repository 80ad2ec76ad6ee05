import random
from collections import Counter

import pytest
from graphs import brute_walks, graph

from walkweave.graph import TRIPLE, entity_frame
from walkweave.operators.upkeep import walk_changes
from walkweave.streaming.walk_store import WalkStore

NAMES = "abcdefgh"


def triples(spark, rows):
    return spark.createDataFrame(list(rows), TRIPLE)


def all_walks(rows, roots, depth, reverse=False):
    return Counter((r, w) for r in set(roots) for w in brute_walks(rows, r, depth, reverse))


def some(rng, n):
    return {(rng.choice(NAMES), rng.choice("pq"), rng.choice(NAMES + "xyz")) for _ in range(n)}


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("depth", [1, 3])
def test_changes_are_the_difference_of_full_extractions(spark, seed, depth):
    rng = random.Random(seed)
    old, added = some(rng, 14), some(rng, 4)
    removed = set(rng.sample(sorted(old), 5)) | some(rng, 2)
    roots = ["a", "b", "x", "nowhere", "a"]
    new = (old - removed) | added
    reverse = seed % 2 == 1
    twice = [*added, *added, (None, "p", "a"), ("a", None, "b")]
    got = walk_changes(graph(spark, old), triples(spark, twice), triples(spark, [*removed, (None, "p", "a")]), entity_frame(spark, roots), depth, reverse).collect()
    before, after = (all_walks(x, roots, depth, reverse) for x in (old, new))
    assert Counter((r.entity, tuple(r.walk)) for r in got if r.change == 1) == after - before
    assert Counter((r.entity, tuple(r.walk)) for r in got if r.change == -1) == before - after


def test_no_change_no_rows(spark):
    kg, none = graph(spark, [("a", "p", "b")]), triples(spark, [])
    who = entity_frame(spark, ["a"])
    assert not walk_changes(kg, none, none, who, 2).collect()
    assert not walk_changes(kg, triples(spark, [("a", "p", "b")]), triples(spark, [("a", "p", "b"), ("u", "p", "v")]), who, 2).collect()
    assert not walk_changes(kg, triples(spark, [("b", "p", "c")]), none, entity_frame(spark, []), 2).collect()
    with pytest.raises(ValueError):
        walk_changes(kg, none, none, who, 0)


def test_skipped_predicates_stay_out(spark):
    kg = graph(spark, [("a", "p", "b"), ("a", "bad", "c")], skip_predicates=["bad"])
    assert not walk_changes(kg, triples(spark, [("b", "bad", "d")]), triples(spark, [("a", "bad", "c")]), entity_frame(spark, ["a"]), 2).collect()


def test_work_follows_the_change(spark):
    """One new hop of a vertex with very many hops: only the walks through the new hop come."""
    rows = [("hub", "p", f"n{i}") for i in range(3000)] + [(f"r{i}", "p", "hub") for i in range(5)]
    kg, who = graph(spark, rows), entity_frame(spark, [f"r{i}" for i in range(5)])
    made = walk_changes(kg, triples(spark, [("hub", "p", "new")]), triples(spark, [("hub", "p", "n7")]), who, 2)
    got = made.collect()
    assert Counter(r.change for r in got) == {1: 5, -1: 5}
    assert {tuple(r.walk) for r in got if r.change == 1} == {(f"r{i}", "p", "hub", "p", "new") for i in range(5)}


def stored_walks(store):
    return Counter((r.entity, tuple(r.walk)) for r in store.walks().collect())


def test_a_store_follows_random_changes(spark, tmp_path):
    rng = random.Random(9)
    now, roots = some(rng, 12), ["a", "c", "x"]
    store = WalkStore.create(graph(spark, now), entity_frame(spark, roots), str(tmp_path / "s"), 2)
    with pytest.raises(ValueError):
        WalkStore.create(graph(spark, now), entity_frame(spark, roots), str(tmp_path / "s"), 2)
    for step in range(3):
        added, removed = some(rng, 3), set(rng.sample(sorted(now), 3))
        delta = store.apply(triples(spark, added), triples(spark, removed))
        now = (now - removed) | added
        assert stored_walks(store) == all_walks(now, roots, 2)
        assert delta.where("change NOT IN (1, -1)").isEmpty()
        if step == 1:
            store.compact()
            assert stored_walks(store) == all_walks(now, roots, 2)
    again = WalkStore(spark, str(tmp_path / "s"), 2)
    assert again.apply(triples(spark, added), triples(spark, removed - added)).isEmpty()  # brought again
    assert {tuple(r) for r in again.graph().triples.collect()} == now
    with pytest.raises(ValueError):
        WalkStore(spark, str(tmp_path / "none"), 2).walks()


def test_an_attempt_without_its_mark_does_not_count(spark, tmp_path):
    now = {("a", "p", "b"), ("b", "p", "c")}
    store = WalkStore.create(graph(spark, now), entity_frame(spark, ["a"]), str(tmp_path / "s"), 2)
    done, store._done = store._done, lambda *_: (_ for _ in ()).throw(RuntimeError)
    with pytest.raises(RuntimeError):
        store.apply(triples(spark, [("b", "p", "z")]), triples(spark, []))
    assert stored_walks(store) == all_walks(now, ["a"], 2)
    store._done = done
    store.apply(triples(spark, [("b", "p", "d")]), triples(spark, []))
    assert stored_walks(store) == all_walks(now | {("b", "p", "d")}, ["a"], 2)


def test_a_store_follows_a_stream(spark, tmp_path):
    now, change = {("a", "p", "b"), ("b", "p", "c")}, "s string, p string, o string, change int"
    store = WalkStore.create(graph(spark, now), entity_frame(spark, ["a"]), str(tmp_path / "s"), 3)
    came = str(tmp_path / "in")
    for rows in ([("b", "p", "c", -1), ("b", "q", "d", 1), ("e", "p", "f", 1), ("e", "p", "f", -1)], [("d", "p", "a", 1)]):
        spark.createDataFrame(rows, change).coalesce(1).write.mode("append").parquet(came)
        store.follow(spark.readStream.schema(change).parquet(came), str(tmp_path / "c")).awaitTermination()
    assert stored_walks(store) == all_walks({("a", "p", "b"), ("b", "q", "d"), ("d", "p", "a")}, ["a"], 3)


def test_vertices_that_no_root_reaches_are_not_grown_from(spark, monkeypatch):
    """Growing backwards from a changed hop stops at vertices that no root leads to, however many come before it."""
    from walkweave.operators import upkeep

    rows = [(f"s{i}", "p", "hub") for i in range(2000)] + [("hub", "p", "end"), ("root", "p", "a"), ("a", "p", "end")]
    cut, counts = upkeep.cut, []

    def counted(df):
        made = cut(df)
        counts.append(made.count())
        return made

    monkeypatch.setattr(upkeep, "cut", counted)
    for depth in (2, 3):
        got = walk_changes(graph(spark, rows), triples(spark, [("hub", "q", "new"), ("a", "q", "new")]), triples(spark, [("hub", "p", "end")]), entity_frame(spark, ["root"]), depth).collect()
        assert [(r.entity, list(r.walk), r.change) for r in got] == [("root", ["root", "p", "a", "q", "new"], 1)]
        assert max(counts) <= 4


def test_the_graph_is_computed_once(spark):
    from pyspark.sql import functions as F

    from walkweave.graph import KnowledgeGraph

    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(x):
        made.add(1)
        return x

    rows = triples(spark, [(f"a{i}", "p", f"b{i}") for i in range(50)]).coalesce(1)
    kg = KnowledgeGraph(rows.select(seen.asNondeterministic()("s").alias("s"), "p", "o"), distinct=True)
    got = walk_changes(kg, triples(spark, [("b7", "p", "c")]), triples(spark, [("a9", "p", "b9")]), entity_frame(spark, [f"a{i}" for i in range(50)]), 2).collect()
    assert len(got) == 4 and made.value <= 50


@pytest.mark.parametrize("depth", [1, 2, 3])
def test_roots_are_computed_once(spark, depth):
    """Roots may be all vertices of a graph, which no level computes again."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    who = entity_frame(spark, ["a", "b", "c", "a"]).select("entity").mapInArrow(count, "entity string")
    kg = graph(spark, [("a", "p", "b"), ("b", "p", "c"), ("c", "q", "d")])
    got = walk_changes(kg, triples(spark, [("b", "q", "e")]), triples(spark, [("c", "q", "d")]), who, depth).collect()
    assert got and seen.value == 4
