"""The registered queries over the star schema's graph.

Results are scalars: walks are joined by `` > ``, hashes are hexadecimal,
numbers are rounded.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from walkweave.functions.numbers import literal_value
from walkweave.functions.text import fnv_bucket, ngrams
from walkweave.graph import KnowledgeGraph
from walkweave.operators import relabel
from walkweave.operators import literals as lit
from walkweave.operators.sampled import exact_walks, sample_walks
from walkweave.operators.samplers import ObjFreqSampler, ObjPredFreqSampler, PageRankSampler, PredFreqSampler, Sampler, UniformSampler, WideSampler
from walkweave.operators.upkeep import walk_changes
from walkweave.operators.walks import both_ways, expand, labelled, with_root
from walkweave.operators.wl import wl_labels
from walkweave.sources import ntriples
from walkweave.sources.files import read_triples
from walkweave.sources.relational import BALANCE, EDGES, roots, star_graph
from walkweave.spark import shared_folder
from walkweave.streaming.walk_store import WalkStore

from .embedders import FastText, Word2Vec
from .pipeline import upsert
from .walkers import AnonymousWalker, CommunityWalker, RandomWalker, SplitWalker, WLWalker

Query = Callable[[SparkSession, str], DataFrame]
SKIPPED = ("has_priority", "contains")


def _joined(walks: DataFrame, *more: str) -> DataFrame:
    return walks.select(*more, "entity", F.array_join("walk", " > ").alias("walk"))


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roots(spark, sf_dir, "customer", "customer", "c_custkey")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roots(spark, sf_dir, "orders", "order", "o_orderkey")


def nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roots(spark, sf_dir, "nation", "nation", "n_nationkey")


def triples_load(spark, sf_dir):
    return star_graph(spark, sf_dir).triples


def skip_predicates(spark, sf_dir):
    return star_graph(spark, sf_dir, skip_predicates=SKIPPED).triples


def ntriples_roundtrip(spark, sf_dir):
    """The graph written as N-Triples and read again."""
    path = f"{shared_folder(spark)}/tables/{uuid.uuid4().hex}"
    ntriples.write(star_graph(spark, sf_dir).triples, path)
    return KnowledgeGraph(ntriples.read(spark, path)).triples


def turtle_roundtrip(spark, sf_dir):
    """The graph written as N-Triples, which is Turtle too, and read by the Turtle reader in byte ranges; predicates get a scheme on the way, as Turtle's names may be relative."""
    path = f"{shared_folder(spark)}/tables/{uuid.uuid4().hex}"
    ntriples.write(star_graph(spark, sf_dir).triples.withColumn("p", F.concat(F.lit("urn:"), "p")), path)
    return KnowledgeGraph(read_triples(spark, path, "turtle")).triples.withColumn("p", F.substr("p", F.lit(5)))


def add_vertices(spark, sf_dir):
    """Isolated vertices beside those of the graph, some of which are there already."""
    more = customers(spark, sf_dir).select(F.explode(F.array("entity", F.concat("entity", F.lit("x")))).alias("v"))
    return star_graph(spark, sf_dir).add_vertices(more).vertices()


def add_edges(spark, sf_dir):
    """More triples, partly known ones, into a graph without some predicates."""
    kg = star_graph(spark, sf_dir, skip_predicates=SKIPPED)
    return kg.add(star_graph(spark, sf_dir, edges=[*EDGES[:3], BALANCE]).triples).triples


def entity_gate(spark, sf_dir):
    """Which of the asked entities the graph lacks: those that a fit refuses."""
    asked = customers(spark, sf_dir).select(F.concat("entity", F.when(F.col("pos") % 5 == 0, "x").otherwise("")).alias("entity"))
    return star_graph(spark, sf_dir).exists(asked).where("NOT exists").select("entity")


def tokens_bytes(spark, sf_dir):
    """The default tokens of random walks, as Python shows bytes."""
    return relabel.token_labels(star_graph(spark, sf_dir).vertices(), nations(spark, sf_dir))


def random_walk_bytes(spark, sf_dir):
    return _joined(RandomWalker(2).extract(star_graph(spark, sf_dir), customers(spark, sf_dir)))


def remove_triples(spark, sf_dir):
    kg = star_graph(spark, sf_dir)
    return kg.remove(kg.triples.where("p = 'placed_by' AND o RLIKE '[02468]$'")).triples


def hops_fwd(spark, sf_dir):
    return star_graph(spark, sf_dir).hops()


def hops_rev(spark, sf_dir):
    return star_graph(spark, sf_dir).hops(True)


def vertices(spark, sf_dir):
    return star_graph(spark, sf_dir).vertices()


def neighbors(spark, sf_dir):
    return star_graph(spark, sf_dir).neighbors("nation:3", reverse=True)


def exist_check(spark, sf_dir):
    asked = customers(spark, sf_dir).select("entity", F.concat("entity", F.lit("x")).alias("other"))
    return star_graph(spark, sf_dir).exists(asked.select(F.explode(F.array("entity", "other")).alias("entity")))


def bfs(entities: Callable, depth: int, reverse: bool = False) -> Query:
    return lambda spark, sf_dir: _joined(expand(star_graph(spark, sf_dir).hops(reverse), entities(spark, sf_dir), depth, reverse))


def bfs_with_reverse_d1(spark, sf_dir):
    kg, who = star_graph(spark, sf_dir), customers(spark, sf_dir)
    return _joined(both_ways(expand(kg.hops(), who, 1), expand(kg.hops(True), who, 1, True)), "root_idx")


def walk_hash(spark, sf_dir):
    kg, who = star_graph(spark, sf_dir), orders(spark, sf_dir)
    return _joined(expand(labelled(kg.hops(), relabel.token_labels(kg.vertices(), who, style="hex")), who, 2))


def _plain(spark, sf_dir, entities, depth) -> DataFrame:
    return with_root(expand(star_graph(spark, sf_dir).hops(), entities(spark, sf_dir), depth))


def anonymous(spark, sf_dir):
    return _joined(relabel.anonymous(_plain(spark, sf_dir, orders, 2)))


def walklet(spark, sf_dir):
    return _joined(relabel.walklets(_plain(spark, sf_dir, orders, 2)))


def walklet_reverse(spark, sf_dir):
    kg, who = star_graph(spark, sf_dir), customers(spark, sf_dir)
    return _joined(relabel.walklets(both_ways(expand(kg.hops(), who, 1), expand(kg.hops(True), who, 1, True)), reverse=True))


def ngram_g3(spark, sf_dir):
    return _joined(relabel.ngram_walks(star_graph(spark, sf_dir).hops(), orders(spark, sf_dir), 3, 3))


def ngram_wildcard1(spark, sf_dir):
    return _joined(relabel.ngrams(_plain(spark, sf_dir, customers, 2), 3, [1]))


def split_tokens(spark, sf_dir):
    return _joined(SplitWalker(2).extract(star_graph(spark, sf_dir), orders(spark, sf_dir)))


def halk(thresholds: tuple[float, ...]) -> Query:
    return lambda spark, sf_dir: _joined(relabel.drop_rare_hops(_plain(spark, sf_dir, orders, 2), thresholds), "threshold_idx")


def wl(rounds: int) -> Query:
    return lambda spark, sf_dir: list(wl_labels(star_graph(spark, sf_dir), rounds, style="hex"))[-1]


def wl_walks(spark, sf_dir):
    return _joined(WLWalker(2, wl_iterations=1, token_style="hex").extract(star_graph(spark, sf_dir), customers(spark, sf_dir)))


def weighed(sampler: Callable[[], Sampler], digits: int = 6) -> Query:
    def query(spark, sf_dir):
        kg = star_graph(spark, sf_dir)
        return sampler().fit(kg).weigh(kg.hops()).select("v", "p", "n", F.round("w", digits).alias("w"))

    return query


def shares(inverse: bool, split: bool) -> Query:
    def query(spark, sf_dir):
        kg = star_graph(spark, sf_dir)
        return PredFreqSampler(inverse, split).fit(kg).probabilities(kg.hops()).select("v", "p", "n", F.round("prob", 6).alias("prob"))

    return query


def dfs_fixed_u(spark, sf_dir):
    kg = star_graph(spark, sf_dir)
    return _joined(sample_walks(kg, orders(spark, sf_dir), 2, 1, PredFreqSampler(inverse=True).fit(kg), seed=42, draw="fixed"))


def dfs_hashed(spark, sf_dir):
    kg = star_graph(spark, sf_dir)
    return _joined(sample_walks(kg, orders(spark, sf_dir), 3, 4, ObjFreqSampler(inverse=True).fit(kg), seed=7))


def dfs_exact(spark, sf_dir):
    kg = star_graph(spark, sf_dir)
    return _joined(exact_walks(kg, customers(spark, sf_dir), 2, 4, UniformSampler().fit(kg)), "number")


def _with_balance(spark, sf_dir, chains) -> KnowledgeGraph:
    return star_graph(spark, sf_dir, edges=[*EDGES, BALANCE], literals=chains)


def _values(found: DataFrame) -> DataFrame:
    rows = found.select("entity", "chain_idx", "kind", F.explode_outer("values").alias("x"))
    return rows.select("entity", "chain_idx", "kind", F.round("x.num", 6).alias("num"), F.col("x.str").alias("str"))


def literals_chain1(spark, sf_dir):
    return _values(lit.literals(_with_balance(spark, sf_dir, [["has_balance"], ["in_segment"], ["has_brand"]]), customers(spark, sf_dir)))


def literals_chain2(spark, sf_dir):
    return _values(lit.literals(_with_balance(spark, sf_dir, [["placed_by", "has_balance"], ["contains", "has_brand"]]), orders(spark, sf_dir)))


def literals_cast(spark, sf_dir):
    tables = [("customer", "c_acctbal"), ("customer", "c_mktsegment"), ("orders", "o_orderpriority"), ("part", "p_size"), ("part", "p_brand")]
    texts = reduce(DataFrame.unionByName, [spark.read.parquet(f"{sf_dir}/{t}.parquet").select(F.col(c).cast("string").alias("text")) for t, c in tables]).distinct()
    return texts.withColumn("x", literal_value(F.col("text"))).select("text", F.round("x.num", 6).alias("num"), F.col("x.str").alias("str"))


def literal_features(spark, sf_dir):
    found = lit.features(lit.literals(_with_balance(spark, sf_dir, [["from_nation"], ["has_balance"]]), customers(spark, sf_dir)))
    return found.select("entity", "chain_idx", "n", "has_any", *[F.round(c, 6).alias(c) for c in ("least", "greatest", "total", "mean", "spread")])


def upsert_walks(spark, sf_dir):
    kg, who = star_graph(spark, sf_dir), customers(spark, sf_dir)
    old = expand(kg.hops(), who.where("pos % 3 <> 0"), 1)
    return _joined(upsert(old, expand(kg.hops(), who.where("pos % 2 = 0"), 2)))


def _change(spark, sf_dir):
    """A change of the graph: parts lose their brands and become ends, customers in one segment move out of it, regions, which were ends, get a hop, and customers their balances."""
    kg = star_graph(spark, sf_dir)
    own = lambda *names: star_graph(spark, sf_dir, edges=[e for e in EDGES if e[0] in names]).triples  # noqa: E731 - a part of the graph, from its tables alone
    regions = own("in_region").select(F.col("o").alias("s"), F.lit("part_of").alias("p"), F.lit("world").alias("o")).distinct()
    removed = own("has_brand", "in_segment").where("p = 'has_brand' OR (p = 'in_segment' AND o = 'MACHINERY')")
    return kg, regions.unionByName(star_graph(spark, sf_dir, edges=[BALANCE]).triples), removed


def walk_delta(spark, sf_dir):
    """The walks of orders that the change brings and takes away."""
    kg, added, removed = _change(spark, sf_dir)
    return _joined(walk_changes(kg, added, removed, orders(spark, sf_dir), 2), "change")


def walk_delta_rev(spark, sf_dir):
    """The same for walks that lead to any vertex, brands and segments among them, against the hops."""
    kg, added, removed = _change(spark, sf_dir)
    return _joined(walk_changes(kg, added, removed, kg.vertices().withColumnRenamed("v", "entity"), 2, True), "change")


def kept_walks(spark, sf_dir):
    """All walks of customers in a store that has followed the change."""
    kg, added, removed = _change(spark, sf_dir)
    store = WalkStore.create(kg, customers(spark, sf_dir), f"{shared_folder(spark)}/tables/{uuid.uuid4().hex}", 3)
    store.apply(added, removed)
    return _joined(store.walks())


def multi_walker(spark, sf_dir):
    kg, who = star_graph(spark, sf_dir), customers(spark, sf_dir)
    walkers = [RandomWalker(1, token_style="hex"), AnonymousWalker(2)]
    return reduce(DataFrame.unionByName, [_joined(w.extract(kg, who).withColumn("walker_idx", F.lit(i)), "walker_idx") for i, w in enumerate(walkers)])


def fasttext_hash(spark, sf_dir):
    names = star_graph(spark, sf_dir).vertices().select(F.col("v").alias("name"))
    return names.select("name", F.explode(ngrams(F.col("name"))).alias("gram")).select("name", "gram", fnv_bucket(F.col("gram"), 2_000_000).alias("bucket"))


def w2v_vectors(spark, sf_dir):
    kg, who = star_graph(spark, sf_dir), customers(spark, sf_dir)
    return Word2Vec(vector_size=16, epochs=1, seed=42, hs=True).fit(RandomWalker(2).extract(kg, who)).transform(who)


def w2v_cbow_vectors(spark, sf_dir):
    kg, who = star_graph(spark, sf_dir), customers(spark, sf_dir)
    return Word2Vec(vector_size=16, epochs=2, seed=42).fit(RandomWalker(2).extract(kg, who)).transform(who)


def w2v_neighbours(spark, sf_dir):
    """For each nation, whether its customers' skip-gram vectors are closer to each other than to those of other nations' customers."""
    kg, who = star_graph(spark, sf_dir), customers(spark, sf_dir)
    size = 16
    made = Word2Vec(size, epochs=8, step=0.3, negative=10, sample=0, seed=42, sg=True, parts=2).fit(RandomWalker(2, md5_bytes=None).extract(kg, who)).transform(who)
    of = star_graph(spark, sf_dir, edges=EDGES[1:2]).triples.select(F.col("s").alias("entity"), F.col("o").alias("nation"))
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
    units = made.join(of, "entity").select("nation", F.transform("vector", lambda x: x / length).alias("u"))
    total = F.array(*[F.sum(F.get("u", F.lit(i))) for i in range(size)]).alias("s")
    sums = units.groupBy("nation").agg(F.count(F.lit(1)).alias("n"), total)
    every = units.agg(F.count(F.lit(1)).alias("m"), total).first()  # one row
    m, t = F.lit(every["m"]), F.lit(list(every["s"]))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)
    own = dot("s", "s")
    near, far = (own - F.col("n")) / (F.col("n") * (F.col("n") - 1)), (dot("s", t) - own) / (F.col("n") * (m - F.col("n")))
    return sums.select("nation", "n", F.when((F.col("n") > 1) & (m > F.col("n")), near > far).alias("closer"))


def fasttext_vectors(spark, sf_dir):
    kg, who = star_graph(spark, sf_dir), customers(spark, sf_dir)
    return FastText(vector_size=8, negative=5, epochs=2, step=0.05, seed=42, sg=True).fit(RandomWalker(2).extract(kg, who)).transform(who)


def community_walks(spark, sf_dir):
    return _joined(CommunityWalker(1, hop_prob=0.3, random_state=42, md5_bytes=None).extract(star_graph(spark, sf_dir), customers(spark, sf_dir)))


QUERIES: dict[str, Query] = {
    "triples_load": triples_load,
    "skip_predicates": skip_predicates,
    "remove_triples": remove_triples,
    "ntriples_roundtrip": ntriples_roundtrip,
    "turtle_roundtrip": turtle_roundtrip,
    "add_vertices": add_vertices,
    "add_edges": add_edges,
    "entity_gate": entity_gate,
    "tokens_bytes": tokens_bytes,
    "random_walk_bytes": random_walk_bytes,
    "hops_fwd": hops_fwd,
    "hops_rev": hops_rev,
    "vertices": vertices,
    "neighbors": neighbors,
    "exist_check": exist_check,
    "bfs_d1": bfs(orders, 1),
    "bfs_d2": bfs(customers, 2),
    "bfs_d3": bfs(orders, 3),
    "bfs_rev_d2": bfs(nations, 2, True),
    "bfs_with_reverse_d1": bfs_with_reverse_d1,
    "walk_hash": walk_hash,
    "anonymous": anonymous,
    "walklet": walklet,
    "walklet_reverse": walklet_reverse,
    "ngram_g3": ngram_g3,
    "ngram_wildcard1": ngram_wildcard1,
    "split_tokens": split_tokens,
    "halk_t": halk((0.1,)),
    "halk_multi_threshold": halk((0.1, 0.2, 0.9)),
    "wl_1": wl(1),
    "wl_2": wl(2),
    "wl_walks": wl_walks,
    "w_uniform": weighed(UniformSampler),
    "w_objfreq": weighed(ObjFreqSampler),
    "w_predfreq": weighed(PredFreqSampler),
    "w_objpredfreq": weighed(ObjPredFreqSampler),
    "w_wide": weighed(WideSampler),
    "w_pagerank": weighed(lambda: PageRankSampler(rounds=10, fixed=True), 9),
    "weights_plain": shares(False, False),
    "weights_inverse": shares(True, False),
    "weights_split": shares(False, True),
    "weights_inverse_split": shares(True, True),
    "dfs_fixed_u": dfs_fixed_u,
    "dfs_hashed": dfs_hashed,
    "dfs_exact": dfs_exact,
    "literals_chain1": literals_chain1,
    "literals_chain2": literals_chain2,
    "literals_cast": literals_cast,
    "literal_features": literal_features,
    "upsert_walks": upsert_walks,
    "walk_delta": walk_delta,
    "walk_delta_rev": walk_delta_rev,
    "kept_walks": kept_walks,
    "multi_walker": multi_walker,
    "fasttext_hash": fasttext_hash,
    "w2v_vectors": w2v_vectors,
    "w2v_cbow_vectors": w2v_cbow_vectors,
    "w2v_neighbours": w2v_neighbours,
    "fasttext_vectors": fasttext_vectors,
    "community_walks": community_walks,
}
