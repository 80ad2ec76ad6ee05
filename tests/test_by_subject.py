"""The star schema's graph lies by subject, and walks are dealt without what their columns hold twice."""

import os

import pytest
from pyspark.sql import functions as F

from walkweave.functions.text import node_text, node_words
from walkweave.graph import KnowledgeGraph, entity_frame
from walkweave.operators import relabel
from walkweave.operators.walks import expand, with_root
from walkweave.sources.relational import star_graph

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")
def test_hops_of_the_star_schema_are_not_dealt_again(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        hops = star_graph(spark, SF).hops()
        asked = hops.select("v").distinct()
        text = plan(hops.join(asked, "v"))
        assert "lineitem" in text or "l_orderkey" in text
        assert "ENSURE_REQUIREMENTS" not in text
        assert hops.join(asked, "v").count() == hops.count() == star_graph(spark, SF).triples.distinct().count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", ["order:12", "abc123", "abc123d", "a1.b2", "Part#7", "", "--", "nan", "1e3", "12.50", "http://x.org/a#Foo_9", "Zażółć7", "1-URGENT", "x", "infinity", "NaN x"])
def test_node_text_is_node_words(spark, name):
    got, want = spark.createDataFrame([(name,)], "x string").select(node_text(F.col("x"), "\u0001"), F.transform(node_words(F.col("x")), F.lower)).first()
    assert [w for w in got.split("\u0001") if w] == [w for w in want if w]


@pytest.mark.parametrize("include_root", [True, False])
def test_split_walks_are_split_words(spark, include_root):
    rows = [("a1", "hasThing", "b2"), ("a1", "HasThing", "b_2"), ("a1", "is", "a1"), ("b2", "has thing", "c 3.5"), ("b_2", "has_thing", "1e3"), ("alone", "p", "a1")]
    hops, who = KnowledgeGraph.from_rows(spark, rows).hops(), entity_frame(spark, ["a1", "b2", "nobody", "alone"])
    got, want = relabel.split_walks(hops, who, 2, include_root), relabel.split_words(with_root(expand(hops, who, 2)), include_root)
    show = lambda df: sorted((r.entity, r.root_idx, tuple(r.walk)) for r in df.collect())
    assert show(got) == show(want)


def test_rare_hops_are_found_once_for_a_pattern(spark):
    """Walks are joined with what is left of their patterns, and none is taken apart."""
    rows = [("a", "p", "b"), ("a", "q", "c"), ("b", "r", "d"), ("e", "r", "d"), ("f", "p", "c"), ("g", "p", "c")]
    walks = with_root(expand(KnowledgeGraph.from_rows(spark, rows).hops(), entity_frame(spark, list("abefgh")), 2))
    made = relabel.drop_rare_hops(walks, (0.1, 0.3, 0.9))
    assert "join" in plan(made).lower()
    got = sorted((r.threshold_idx, r.entity, "-".join(r.walk)) for r in made.collect())
    full = {"a": ["a-p-b-r-d", "a-q-c"], "b": ["b-r-d"], "e": ["e-r-d"], "f": ["f-p-c"], "g": ["g-p-c"], "h": ["h"]}
    share = {"p": 3 / 7, "q": 1 / 7, "r": 3 / 7}
    want = []
    for k, t in enumerate((0.1, 0.3, 0.9)):
        for e, ws in full.items():
            cuts = []
            for w in (w.split("-") for w in ws):
                keep = [w[0]] + [x for i in range(1, len(w), 2) if share[w[i]] >= t for x in w[i : i + 2]]
                cuts += [keep] if len(keep) >= 3 else []
            want += [(k, e, "-".join(w)) for w in cuts or [[e]]]
    assert got == sorted(want)


@pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")
def test_labels_of_the_first_round_deal_triples_once(spark):
    """Neither the graph nor its vertices are dealt by subject for labels; triples meet where they end."""
    from walkweave.operators import wl

    kg = star_graph(spark, SF)
    assert "REPARTITION_BY_COL" not in plan(kg.vertices())
    seen, cut = [], wl.cut
    wl.cut = lambda df: (seen.append(plan(df)), cut(df))[1]
    try:
        list(wl.wl_labels(kg, 2, style="hex"))
    finally:
        wl.cut = cut
    assert len(seen) == 2 and not any("REPARTITION_BY_COL" in text or "hashpartitioning(s#" in text for text in seen)


def test_ngram_walks_are_dealt_once(spark):
    rows = [("a", "p", "b"), ("b", "q", "c"), ("c", "r", "d"), ("d", "p", "a"), ("a", "q", "e")]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        made = relabel.ngram_walks(KnowledgeGraph.from_rows(spark, rows).hops(), entity_frame(spark, list("abz")), 3)
        assert sum("xxhash64" in line and "Exchange" in line for line in plan(made).splitlines()) == 1
        assert len(made.collect()) == 4
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def unhinted(spark, make):
    """What is made without broadcasts that come from sizes."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return make()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_walks_that_come_and_go_grow_in_the_same_joins(spark):
    from walkweave.operators.upkeep import walk_changes

    kg = KnowledgeGraph.from_rows(spark, [("a", "p", "b"), ("b", "p", "c"), ("d", "p", "b")])
    triples = lambda *rows: spark.createDataFrame(list(rows), "s string, p string, o string")
    made = unhinted(spark, lambda: walk_changes(kg, triples(("c", "q", "x"), ("b", "q", "y")), triples(("b", "p", "c")), entity_frame(spark, ["a", "c"]), 2))
    text = unhinted(spark, lambda: plan(made))
    assert sum("xxhash64" in line and "Exchange" in line for line in text.splitlines()) == 1
    assert sorted(("-".join(r.walk), r.change) for r in made.collect()) == [("a-p-b-p-c", -1), ("a-p-b-q-y", 1), ("c", -1), ("c-q-x", 1)]


def test_sampled_walks_store_no_choices(spark):
    from walkweave.operators.sampled import sample_walks
    from walkweave.operators.samplers import ObjFreqSampler
    from walkweave.spark import folders, shared_folder

    kg = KnowledgeGraph.from_rows(spark, [("a", "p", "b"), ("a", "p", "c"), ("b", "q", "a")])
    tables = f"{shared_folder(spark)}/tables"
    before = folders(spark, tables)
    for split in (False, True):
        got = sample_walks(kg, entity_frame(spark, ["a", "z"]), 2, 8, ObjFreqSampler(inverse=True, split=split).fit(kg), seed=1).collect()
        assert {"-".join(r.walk) for r in got} == {"a-p-b-q-a", "a-p-c", "z"}
    assert folders(spark, tables) == before


@pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")
def test_shares_of_the_star_schema_deal_no_hops_by_their_vertex(spark):
    from walkweave.operators.samplers import PredFreqSampler

    kg = star_graph(spark, SF)
    text = unhinted(spark, lambda: plan(PredFreqSampler(True).fit(kg).probabilities(kg.hops())))
    assert "hashpartitioning(v#" not in text and "ENSURE_REQUIREMENTS" not in text.replace("BroadcastExchange", "")
