from itertools import combinations

import pytest
from graphs import CHAIN, LOOP, PREFIX, ROOTS, brute_walks, full, graph, roots, short

from walkweave.graph import entity_frame
from walkweave.operators import relabel
from walkweave.operators.sampled import exact_walks, fixed_draw, sample_walks
from walkweave.operators.samplers import ObjFreqSampler, PredFreqSampler, UniformSampler
from walkweave.operators.walks import both_ways, expand, with_root
from walkweave.operators.wl import wl_labels
from walkweave.plans import walkers as W


def collected(df):
    return sorted((r.entity, tuple(r.walk)) for r in df.collect())


@pytest.mark.parametrize("rows", [LOOP, CHAIN])
@pytest.mark.parametrize("reverse", [False, True])
@pytest.mark.parametrize("depth", [0, 1, 2, 5])
def test_all_walks(spark, rows, reverse, depth):
    got = collected(expand(graph(spark, rows).hops(reverse), roots(spark), depth, reverse))
    assert got == sorted((r, w) for r in ROOTS for w in brute_walks(rows, r, depth, reverse))


def test_known_counts(spark):
    hops = graph(spark, LOOP).hops()
    counts = {short(r.entity): r["count"] for r in expand(hops, roots(spark), 8).groupBy("entity").count().collect()}
    assert counts == {"Alice": 12, "Bob": 7, "Dean": 9}


def test_both_directions_share_the_root(spark):
    kg = graph(spark, LOOP)
    made = both_ways(expand(kg.hops(), roots(spark), 2), expand(kg.hops(True), roots(spark), 1, True)).collect()
    for r in made:
        assert r.walk[r.root_idx] == r.entity
    want = {(b[:-1] + f) for root in ROOTS for f in brute_walks(LOOP, root, 2) for b in brute_walks(LOOP, root, 1, True)}
    assert {tuple(r.walk) for r in made} == want


def test_exact_sampling_golden(spark):
    kg = graph(spark, LOOP)
    got = exact_walks(kg, entity_frame(spark, full("Alice")), 2, 5, UniformSampler().fit(kg)).orderBy("number").collect()
    assert ["-".join(map(short, r.walk)) for r in got] == ["Alice-knows-Bob-knows-Dean", "Alice-knows-Bob", "Alice-knows-Dean-loves-Alice", "Alice-knows-Dean", "Alice"]
    assert fixed_draw(42) == 0.3745401188473625


@pytest.mark.parametrize("reverse", [False, True])
def test_exact_sampling_takes_existing_ways(spark, reverse):
    kg = graph(spark, CHAIN)
    got = exact_walks(kg, entity_frame(spark, [*ROOTS, "nobody"]), 3, 4, ObjFreqSampler(inverse=True, split=True).fit(kg), reverse).collect()
    assert len(got) == 16
    for r in got:
        walk = tuple(r.walk)
        full_walks = brute_walks(CHAIN, r.entity, 3, reverse)
        assert any(w[-len(walk) :] == walk if reverse else w[: len(walk)] == walk for w in full_walks)


@pytest.mark.parametrize("draw", ["hashed", "fixed"])
@pytest.mark.parametrize("reverse", [False, True])
def test_sampled_walks_are_walks(spark, draw, reverse):
    kg = graph(spark, LOOP)
    got = collected(sample_walks(kg, roots(spark), 3, 4, PredFreqSampler().fit(kg), reverse, seed=3, draw=draw))
    every = {(r, w) for r in ROOTS for w in brute_walks(LOOP, r, 3, reverse)}
    assert set(got) <= every and {e for e, _ in got} == set(ROOTS) and len(got) <= 12
    again = collected(sample_walks(kg, roots(spark), 3, 4, PredFreqSampler().fit(kg), reverse, seed=3, draw=draw))
    assert got == again


def test_sampled_hops_follow_the_shares(spark):
    rows = [("r", "p", f"n{i}") for i in range(10)] + [(f"m{j}", "q", "n0") for j in range(90)]
    kg = graph(spark, rows)
    names = [f"e{i}" for i in range(2000)]
    kg = kg.add(spark.createDataFrame([(n, "to", "r") for n in names], "s string, p string, o string"))
    got = sample_walks(kg, entity_frame(spark, names), 2, 1, ObjFreqSampler().fit(kg), seed=1).collect()
    share = sum(r.walk[-1] == "n0" for r in got) / len(got)
    assert abs(share - 91 / 100) < 0.03


def test_anonymous(spark):
    walks = spark.createDataFrame([("a", 0, ["a", "p", "b", "p", "a", "q", "b"])], "entity string, root_idx int, walk array<string>")
    assert relabel.anonymous(walks).first().walk == ["a", "1", "2", "1", "a", "5", "2"]


def test_walklets(spark):
    walks = spark.createDataFrame([("r", 2, ["a", "p", "r", "q", "b"]), ("s", 0, ["s"])], "entity string, root_idx int, walk array<string>")
    assert {tuple(r.walk) for r in relabel.walklets(walks).collect()} == {("r", "a"), ("r", "p"), ("r", "q"), ("r", "b"), ("s",)}
    assert {tuple(r.walk) for r in relabel.walklets(walks, True, skip_first=True).collect()} == {("p", "r"), ("q", "r"), ("b", "r"), ("s",)}


def test_ngrams_and_wildcards(spark):
    walks = spark.createDataFrame([("a", 0, ["a", "p", "b", "q", "c"]), ("x", 0, ["x", "p", "b", "q", "c"])], "entity string, root_idx int, walk array<string>")
    got = {r.entity: list(r.walk) for r in relabel.ngrams(walks, 3).collect()}
    assert got["a"][:4] == ["a", "p", "b", "q"] and got["a"][4] == got["x"][4] == "0"
    wild = relabel.wildcard_walks(walks, [1, 2]).where("entity = 'a'").collect()
    assert len(wild) == 1 + 4 + 6 and all(r.walk[0] == "a" for r in wild)
    long = spark.createDataFrame([("n0", 0, [f"n{i}" for i in range(61)])], "entity string, root_idx int, walk array<string>")
    assert {tuple(i for i, x in enumerate(r.walk) if x == "*") for r in relabel.wildcard_walks(long, [2]).collect()} == {(), *combinations(range(1, 61), 2)}
    assert relabel.wildcard_walks(walks, [5]).count() == 2


@pytest.mark.parametrize("grams", [1, 2, 3])
@pytest.mark.parametrize("depth", [0, 1, 3, 4])
def test_ngrams_of_hops_are_those_of_walks(spark, grams, depth):
    """The same walks and numbers as from whole walks, without taking a walk apart."""
    rows = [*map(tuple, LOOP), *map(tuple, CHAIN), ("x", "p", "y")]
    kg, who = graph(spark, rows), roots(spark, [*ROOTS, "x", "nowhere", "x"])
    got = relabel.ngram_walks(kg.hops(), who, depth, grams)
    assert sorted((r.entity, r.root_idx, tuple(r.walk)) for r in got.collect()) == sorted((r.entity, r.root_idx, tuple(r.walk)) for r in relabel.ngrams(with_root(expand(kg.hops(), who, depth)), grams).collect())
    made = W.NGramWalker(depth, grams=grams).extract(kg, who)
    assert collected(made) == collected(got)
    assert "map_from_entries" not in made._jdf.queryExecution().toString()


def test_split_words(spark):
    name = "http://x.org/c#"
    walks = spark.createDataFrame([(name + "d19", 0, [name + "d19", name + "hasBond", name + "bond3209"])], "entity string, root_idx int, walk array<string>")
    assert relabel.split_words(walks).first().walk == [name + "d19", "has", "bond", "3209"]
    assert relabel.split_words(walks, include_root=False).first().walk == ["has", "bond", "3209"]


@pytest.mark.parametrize("reverse", [False, True])
def test_words_of_hops_are_words_of_walks(spark, reverse):
    rows = [("http://x.org/a#d19", "http://x.org/a#hasBond", "http://x.org/a#bond3209"), ("http://x.org/a#bond3209", "isIn", "12.5"), ("http://x.org/a#bond3209", "isIn", "***")]
    kg, who = graph(spark, rows), entity_frame(spark, [rows[0][0], rows[1][0], "12.5"])
    plain = W.Walker(2, with_reverse=reverse).walks(kg, who, None)
    got = W.SplitWalker(2, with_reverse=reverse).extract(kg, who)
    assert collected(got) == collected(relabel.split_words(plain, reverse=reverse))


@pytest.mark.parametrize("most", [500, 0])
def test_rare_hops(spark, most):
    rows = [("a", 0, ["a", "p", "b", "rare", "c", "p", "d"]), ("a", 0, ["a", "p", "b"]), ("z", 0, ["z", "rare2", "y"]), ("b", 2, ["a", "rare", "b", "p", "c"])]
    walks = spark.createDataFrame(rows, "entity string, root_idx int, walk array<string>")
    got = sorted((r.threshold_idx, r.entity, r.root_idx, tuple(r.walk)) for r in relabel.drop_rare_hops(walks, [0.0, 0.6], most).collect())
    assert [g for g in got if g[0] == 1] == [(1, "a", 0, ("a", "p", "b")), (1, "a", 0, ("a", "p", "b", "p", "d")), (1, "b", 0, ("b", "p", "c")), (1, "z", 0, ("z",))]
    assert sorted(g[1:] for g in got if g[0] == 0) == sorted((e, i, tuple(w)) for e, i, w in rows)


def test_wl_labels(spark):
    from walkweave.functions.tokens import bytes_token
    from pyspark.sql import functions as F
    import hashlib

    kg = graph(spark, LOOP)
    names = {n for s, _, o in LOOP for n in (s, o)}
    nodes, edges = {n: n for n in names}, {tuple(t): t[1] for t in LOOP}
    token = lambda x: hashlib.md5(x.encode()).hexdigest()[:16]
    for labels in wl_labels(kg, 3, style="hex"):
        new_nodes = {n: token(nodes[n] + "-" + "-".join(sorted({edges[t] for t in edges if t[2] == n}))) for n in names}
        edges = {t: token(edges[t] + "-" + nodes[t[0]]) for t in edges}
        nodes = new_nodes
        assert {r.v: r.label for r in labels.collect()} == nodes
    assert F is not None and bytes_token is not None


def test_wl_walks_read_the_hops_near_the_roots(spark, monkeypatch):
    rows = [("r", "p", "a"), ("a", "q", "b"), ("b", "p", "c")] + [(f"s{i}", "p", "r") for i in range(50)]
    sizes, stored = [], W.stored

    def counted(df):
        made = stored(df)
        sizes.append(made[0].count())
        return made

    monkeypatch.setattr(W, "stored", counted)
    got = W.WLWalker(2, wl_iterations=1, md5_bytes=None).extract(graph(spark, rows), roots(spark, ["r"])).collect()
    assert sizes == [2] and {tuple(r.walk) for r in got} == {("r", "p", "a", "q", "b"), ("r", "p", "a-p", "q", "b-q")}


def test_wl_labels_of_the_last_round_store_no_triples(spark, monkeypatch):
    from walkweave.operators import wl

    cut, columns = wl.cut, []

    def noted(df):
        columns.append(df.columns)
        return cut(df)

    monkeypatch.setattr(wl, "cut", noted)
    assert len(list(wl_labels(graph(spark, LOOP), 3))) == 3
    assert columns.count(["v", "label"]) == 3 and columns.count(["s", "p", "o", "label"]) == 1


WALKERS = [W.RandomWalker, W.AnonymousWalker, W.WalkletWalker, W.NGramWalker, W.SplitWalker, W.HALKWalker, W.WLWalker, W.CommunityWalker]


@pytest.mark.parametrize("kind", WALKERS)
@pytest.mark.parametrize("reverse", [False, True])
@pytest.mark.parametrize("walks", [None, 3])
def test_every_walker(spark, kind, reverse, walks):
    more = {"wl_iterations": 1} if kind is W.WLWalker else {"hop_prob": 0.5} if kind is W.CommunityWalker else {}
    got = kind(2, walks, with_reverse=reverse, random_state=5, **more).extract(graph(spark, LOOP), roots(spark)).collect()
    assert {r.entity for r in got} == set(ROOTS)
    for r in got:
        if kind not in (W.SplitWalker, W.NGramWalker):
            assert r.walk[r.root_idx] == r.entity
        if kind not in (W.SplitWalker, W.CommunityWalker):
            assert len(r.walk) <= (9 if reverse else 5)
        if kind is W.RandomWalker:
            assert all(x in ROOTS or x.startswith(("b'", 'b"')) for x in r.walk[::2])


def test_walker_parameters(spark):
    for bad in ({"max_depth": -1}, {"max_depth": 1, "max_walks": -1}, {"max_depth": 1, "n_jobs": -2}):
        with pytest.raises(ValueError):
            W.RandomWalker(**bad)
    assert W.RandomWalker(1, 0).extract(graph(spark, LOOP), roots(spark)).count() == 0
    own = W.SplitWalker(1, func_split=lambda names: [names[-1].rpartition("#")[2].lower()]).extract(graph(spark, LOOP), entity_frame(spark, full("Dean")))
    assert [list(r.walk) for r in own.collect()] == [["alice"]]


def test_community_hops_replace_only_vertices(spark):
    got = W.CommunityWalker(2, 3, hop_prob=1.0, random_state=1, md5_bytes=None).extract(graph(spark, LOOP), roots(spark)).collect()
    names = {n for s, _, o in LOOP for n in (s, o)}
    for r in got:
        assert set(r.walk[::2]) <= names and set(r.walk[1::2]) <= {PREFIX + "knows", PREFIX + "loves"}


def test_with_root(spark):
    assert with_root(expand(graph(spark, LOOP).hops(), roots(spark), 0)).where("root_idx = 0").count() == 3


def test_walklets_are_compared_without_their_root(spark):
    """What is dealt holds a pair's other place, not the root once more."""
    walks = spark.createDataFrame([("a", 0, ["a", "p", "b"]), ("a", 0, ["a", "p", "c"]), ("e", 0, ["e"])], "entity string, root_idx int, walk array<string>")
    made = relabel.walklets(walks, reverse=True)
    assert {(r.entity, r.root_idx, tuple(r.walk)) for r in made.collect()} == {("a", 1, ("p", "a")), ("a", 1, ("b", "a")), ("a", 1, ("c", "a")), ("e", 0, ("e",))} and made.count() == 4
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(entity" in plan and "hashpartitioning(entity#" in plan and ", walk#" not in plan.split("hashpartitioning(")[1].split(")")[0]


def test_entities_without_walks_at_some_thresholds(spark):
    rows = [("a", ["a", "p", "b"])] * 1 + [("a", ["a", "q", "c"]), ("d", ["d", "q", "c"]), ("e", ["e"])]
    walks = spark.createDataFrame([(e, 0, w) for e, w in rows], "entity string, root_idx int, walk array<string>")
    found = {(r.threshold_idx, r.entity, tuple(r.walk)) for r in relabel.drop_rare_hops(walks, (0.1, 0.5, 0.9)).collect()}
    every = {(0, e, tuple(w)) for e, w in rows} | {(1, "a", ("a", "q", "c")), (1, "d", ("d", "q", "c")), (1, "e", ("e",))} | {(2, e, (e,)) for e in "ade"}
    assert found == every
    assert {(r.threshold_idx, r.entity, tuple(r.walk)) for r in relabel.drop_rare_hops(walks, (0.1, 0.5, 0.9), most_in_map=0).collect()} == every
