"""PageRank on the simple directed graph of subjects and objects."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from walkweave.graph import KnowledgeGraph
from walkweave.spark import cut

#: Lineage is cut after so many rounds; in between the ranks are kept in memory, and made again where they are lost.
CUT_EVERY = 5


def pagerank(kg: KnowledgeGraph, alpha: float = 0.85, tolerance: float = 1e-6, rounds: int = 100, fixed: bool = False) -> DataFrame:
    """``v, rank`` of every vertex; ranks sum to 1.

    Parallel predicates count once; the rank of vertices without a way on goes
    to all alike.  It stops when the ranks move by less than vertices x
    ``tolerance`` in sum (or, ``fixed``, after ``rounds`` rounds), and fails if
    they have not settled by then.  A round is one job: ways and ranks are dealt
    alike, only what flows is dealt anew, and two sums (the rank of vertices
    without a way on, and the movement) come to the driver together.
    """
    parts = int(kg.triples.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Dealt once, in which they also become distinct; kept as columns, which take a fraction of a checkpoint's rows.
    ways = kg.triples.select("s", "o").repartition(parts, "s").distinct().persist(StorageLevel.MEMORY_AND_DISK_DESER)
    out = ways.groupBy("s").agg(F.count("o").alias("out"))
    vertices = kg.vertices().repartition(parts, "v")
    nodes = cut(vertices.join(out, F.col("v") == F.col("s"), "left").select("v", "out"))
    n, idle = nodes.agg(F.count("v"), F.count_if(F.col("out").isNull())).first()
    if not n:
        ways.unpersist()
        return nodes.select("v", F.lit(0.0).alias("rank"))
    ranks, loose, kept, last = nodes.select("v", "out", F.lit(1.0 / n).alias("rank")), idle / n, None, False
    for k in range(rounds):
        share = ranks.where("out IS NOT NULL").select("v", (F.col("rank") / F.col("out")).alias("share"))
        flow = ways.join(share, F.col("s") == F.col("v")).groupBy("o").agg(F.sum("share").alias("came"))
        new = alpha * (F.coalesce("came", F.lit(0.0)) + F.lit(loose / n)) + (1 - alpha) / n
        moved = ranks.join(flow, F.col("v") == F.col("o"), "left").select("v", "out", new.alias("rank"), F.abs(new - F.col("rank")).alias("moved"))
        last = fixed and k == rounds - 1
        moved = cut(moved) if last or (k + 1) % CUT_EVERY == 0 else moved.persist(StorageLevel.MEMORY_AND_DISK_DESER)
        sums = None if last else moved.agg(F.sum(F.when(F.col("out").isNull(), F.col("rank"))), F.sum("moved")).first()
        if kept is not None:
            kept.unpersist()
        kept, ranks = moved, moved.select("v", "out", "rank")
        if last:
            break
        loose = sums[0] or 0.0
        if not fixed and sums[1] < n * tolerance:
            break
    else:
        if not fixed:
            ways.unpersist()
            raise RuntimeError(f"PageRank did not settle in {rounds} rounds")
    # A checkpoint, so that the ways are no longer needed.
    found = ranks.select("v", "rank") if last else cut(ranks.select("v", "rank"))
    ways.unpersist()
    if kept is not None:
        kept.unpersist()
    return found
