"""Weights of hops, and what makes probabilities of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from walkweave.described import Described
from walkweave.graph import KnowledgeGraph
from walkweave.spark import cut

from .pagerank import pagerank


#: Tables of up to so many predicates are broadcast; few of them hold most triples, so that dealing hops by predicate fills few tasks.
MOST_PREDICATES = 1_000_000


class SamplerNotSupported(ValueError):
    """The sampler needs the whole graph, and the graph is remote."""


def predicate_counts(triples: DataFrame, name: str) -> DataFrame:
    """``p`` and the number of triples with it, to be joined to hops."""
    counts = cut(triples.groupBy("p").agg(F.count("s").alias(name)))
    return F.broadcast(counts) if counts.count() <= MOST_PREDICATES else counts


class Sampler(Described):
    """Base of samplers: :meth:`fit` counts on a graph, :meth:`weigh` adds ``w`` to hops ``v, p, n``.

    ``inverse`` turns weights around (the largest becomes the smallest);
    ``split`` divides them by the in-degree of ``n``.  A hop of unknown weight
    weighs 0; if all hops of a vertex do, they are alike.
    """

    supports_remote = False

    def __init__(self, inverse: bool = False, split: bool = False):
        self.inverse, self.split = inverse, split
        self._graph: KnowledgeGraph | None = None
        #: Marks of the last exact sampling, ``entity, place, v, p, n``: hops exhausted for a root at a place of its walks.
        self.visited: DataFrame | None = None

    def fit(self, kg: KnowledgeGraph) -> Sampler:
        if getattr(kg, "is_remote", False) and not (self.supports_remote and not self.split):
            raise SamplerNotSupported(f"{type(self).__name__} needs the whole graph")
        self._graph = kg
        return self

    @property
    def graph(self) -> KnowledgeGraph:
        if self._graph is None:
            raise ValueError("call fit first")
        return self._graph

    def in_degrees(self) -> DataFrame:
        return self.graph.triples.groupBy("o").agg(F.count("s").alias("degree"))

    def weights(self) -> tuple[DataFrame, list[str]]:
        """The weight table and those of the columns ``p``, ``n`` that it is looked up by."""
        raise NotImplementedError

    def weigh(self, hops: DataFrame) -> DataFrame:
        """``v, p, n, w``: the plain weight of each hop."""
        table, keys = self.weights()
        return hops.join(table, keys, "left").select("v", "p", "n", F.coalesce(F.col("w").cast("double"), F.lit(0.0)).alias("w"))

    def probabilities(self, hops: DataFrame) -> DataFrame:
        """``v, p, n, w, prob``: weights and shares among the hops of a vertex.

        Inverting, then splitting, then normalising; the order matters.  Sums of
        a vertex are aggregated and joined back, so that a vertex with many hops
        is not one task's.
        """
        rows = self.weigh(hops)
        if self.inverse:
            bounds = rows.groupBy("v").agg(F.max("w").alias("most"), F.min("w").alias("least"))
            rows = rows.join(bounds, "v").select("v", "p", "n", (F.col("most") - (F.col("w") - F.col("least"))).alias("w"))
        if self.split:
            rows = rows.join(self.in_degrees(), F.col("n") == F.col("o"), "left")
            rows = rows.select("v", "p", "n", F.when(F.col("degree") > 0, F.col("w") / F.col("degree")).otherwise(F.col("w")).alias("w"))
        # Counted by p, so that sums read the same columns as hops do, and both take what was dealt once.
        totals = rows.groupBy("v").agg(F.sum("w").alias("total"), F.count(F.when(F.length("p") >= 0, 1)).alias("hops"))
        prob = F.when(F.col("total") > 0, F.col("w") / F.col("total")).otherwise(1 / F.col("hops"))
        return rows.join(totals, "v").select("v", "p", "n", "w", prob.alias("prob"))

    def intervals(self, hops: DataFrame) -> DataFrame:
        """``v, p, n, lo, hi``: the shares as intervals of [0, 1), in the order of p and n.

        The hops are dealt by range, so that a vertex with many of them lies in
        several partitions; each starts from the sum of those before.
        """
        rows = cut(self.probabilities(hops).repartitionByRange("v", "p", "n")).withColumn("part", F.shiftright(F.monotonically_increasing_id(), 33))
        sums = rows.groupBy("v", "part").agg(F.sum("prob").alias("own"))
        before = F.sum("own").over(Window.partitionBy("v").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
        starts = sums.select("v", "part", F.coalesce(before, F.lit(0.0)).alias("start"))
        running = F.sum("prob").over(Window.partitionBy("v", "part").orderBy("p", "n").rowsBetween(Window.unboundedPreceding, 0))
        summed = rows.withColumn("running", running).join(starts, ["v", "part"])
        return summed.select("v", "p", "n", (F.col("start") + F.col("running") - F.col("prob")).alias("lo"), (F.col("start") + F.col("running")).alias("hi"))


    def listed(self, hops: DataFrame) -> DataFrame:
        """``v, hops``: the hops of each vertex in the order of p and n, as ``hi, p, n``; for vertices of few hops.

        ``hi`` is where a hop's share of [0, 1) ends, and 2 for the last one, as rounding must leave no gap at 1.
        The hops of a vertex meet once, in one row, and bounds, sums and shares are those of that row.
        """
        rows = self.weigh(hops)
        degree = F.lit(None).cast("bigint")
        if self.split:
            rows, degree = rows.join(self.in_degrees(), F.col("n") == F.col("o"), "left"), F.col("degree")
        hop = F.struct("p", "n", "w", degree.alias("degree"))
        row = rows.groupBy("v").agg(F.sort_array(F.collect_list(hop)).alias("h"))
        plain, number = (lambda x: x["w"]), F.lit(0.0)
        if self.inverse:
            row = row.withColumns({"most": F.array_max(F.transform("h", plain)), "least": F.array_min(F.transform("h", plain))})
            plain = lambda x: F.col("most") - (x["w"] - F.col("least"))
        own = (lambda x: F.when(x["degree"] > 0, plain(x) / x["degree"]).otherwise(plain(x))) if self.split else plain
        row = row.withColumn("ws", F.transform("h", own))
        row = row.withColumn("total", F.aggregate("ws", number, lambda a, x: a + x))
        share = lambda x: F.when(F.col("total") > 0, x / F.col("total")).otherwise(1 / F.size("ws"))
        ends = F.aggregate("ws", F.array().cast("array<double>"), lambda a, x: F.array_append(a, F.coalesce(F.try_element_at(a, F.lit(-1)), number) + share(x)))
        row = row.withColumn("ends", ends)
        last = F.size("h") - 1
        return row.select("v", F.transform("h", lambda x, i: F.struct(F.when(i == last, 2.0).otherwise(F.get("ends", i)).alias("hi"), x["p"].alias("p"), x["n"].alias("n"))).alias("hops"))


class UniformSampler(Sampler):
    """All hops weigh the same."""

    supports_remote = True

    def __init__(self) -> None:
        super().__init__()

    def weigh(self, hops: DataFrame) -> DataFrame:
        return hops.select("v", "p", "n", F.lit(1.0).alias("w"))


class ObjFreqSampler(Sampler):
    """A hop weighs as many triples as end where it leads."""

    def weights(self):
        return self.graph.triples.groupBy(F.col("o").alias("n")).agg(F.count("s").alias("w")), ["n"]


class PredFreqSampler(Sampler):
    """A hop weighs as many triples as have its predicate."""

    def weights(self):
        return predicate_counts(self.graph.triples, "w"), ["p"]


class ObjPredFreqSampler(Sampler):
    """A hop weighs as many triples as have its predicate and end where it leads."""

    def weights(self):
        return self.graph.triples.groupBy("p", F.col("o").alias("n")).agg(F.count("s").alias("w")), ["p", "n"]


class PageRankSampler(Sampler):
    """A hop weighs the PageRank of the vertex that it leads to."""

    def __init__(self, inverse: bool = False, split: bool = False, alpha: float = 0.85, rounds: int = 100, fixed: bool = False):
        super().__init__(inverse, split)
        self.alpha, self.rounds, self.fixed = alpha, rounds, fixed
        self._ranks: DataFrame | None = None

    def fit(self, kg: KnowledgeGraph) -> Sampler:
        super().fit(kg)
        self._ranks = pagerank(kg, self.alpha, rounds=self.rounds, fixed=self.fixed)
        return self

    def weights(self):
        _ = self.graph
        return self._ranks.select(F.col("v").alias("n"), F.col("rank").alias("w")), ["n"]


class WideSampler(Sampler):
    """A hop weighs (1 + ways on from its end) x (triples with its predicate + 1) / 2, if its end is an object."""

    def weigh(self, hops: DataFrame) -> DataFrame:
        triples = self.graph.triples
        wide = triples.groupBy(F.col("s").alias("n")).agg(F.count("o").alias("ways"))
        often = predicate_counts(triples, "often")
        rows = hops.join(wide, "n", "left").join(often, "p", "left")
        return rows.select("v", "p", "n", ((1 + F.coalesce("ways", F.lit(0))) * (F.coalesce("often", F.lit(0)) + 1) / F.lit(2.0)).alias("w"))
