"""Exhaustive walks: one join a level."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from walkweave.spark import cut

#: Lineage is cut after so many levels.
CUT_EVERY = 4


def labelled(hops: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Hops ``v, p, n`` with what walks show of ``n``: ``label`` of ``labels`` (``v, label``), or the name."""
    if labels is None:
        return hops.select("v", "p", "n", F.col("n").alias("label"))
    own = labels.select(F.col("v").alias("n"), "label")
    return hops.join(own, "n", "left").select("v", "p", "n", F.coalesce("label", "n").alias("label"))


def expand(hops: DataFrame, roots: DataFrame, depth: int, reverse: bool = False, node: Callable[[Column], Column] | None = None, predicate: Callable[[Column], Column] | None = None) -> DataFrame:
    """All walks of up to ``depth`` hops from each distinct ``entity``: ``entity, walk``.

    A walk that finds no hop stays as it is.  Reverse walks grow at their head.
    ``hops`` may show vertices under labels (:func:`labelled`).  As triples are
    distinct, extensions are too, and nothing is deduplicated on the way.

    Names are dealt once: a walk's root is its ``entity`` and its last vertex
    where it goes on from, so only what lies between goes beside them.  Finished
    walks look for a name that no vertex has (it begins with a NUL), one of
    many, so that they spread over the join's partitions.  ``node`` and
    ``predicate`` say what walks show of names, the root's aside, each once for a place.
    """
    node, predicate = node or (lambda x: x), predicate or (lambda x: x)
    shown = [c for c in ("label",) if c in hops.columns]  # a copy of the name would be dealt along with it
    hops = hops.select("v", "p", "n", *shown)
    walks = roots.select("entity").distinct().select("entity", F.array().cast("array<string>").alias("mid"), F.col("entity").alias("tail"), *[F.col("entity").alias("last") for _ in shown])

    def put(*names: str) -> Column:
        return F.concat(F.array(*reversed(names)), F.col("mid")) if reverse else F.concat(F.col("mid"), F.array(*names))

    last = "last" if shown else "tail"
    for level in range(depth):
        ended = F.concat(F.lit("\0"), F.xxhash64("entity", "mid").cast("string"))
        joined = walks.join(hops, F.coalesce("tail", ended) == F.col("v"), "left").withColumns({"at": node(F.col(last)), "by": predicate(F.col("p"))})
        # The root is not put: it is the entity.
        stays, goes = (put("at"), put("at", "by")) if level else (F.col("mid"), put("by"))
        mid = F.when(F.col("tail").isNull(), F.col("mid")).when(F.col("n").isNull(), stays).otherwise(goes)
        walks = joined.select("entity", mid.alias("mid"), F.col("n").alias("tail"), *[F.col(c).alias("last") for c in shown])
        if (level + 1) % CUT_EVERY == 0 and level + 1 < depth:
            walks = cut(walks)
    walks = walks.withColumn("at", node(F.col(last)))
    whole = F.when(F.col("tail").isNull(), F.col("mid")).otherwise(put("at")) if depth else F.col("mid")
    return walks.select("entity", (F.concat(whole, F.array("entity")) if reverse else F.concat(F.array("entity"), whole)).alias("walk"))


def within(hops: DataFrame, roots: DataFrame, steps: int) -> DataFrame:
    """The vertices ``v`` that lie up to ``steps`` hops from some ``entity``, the entities among them."""
    last = found = cut(roots.select(F.col("entity").alias("v")).distinct())
    for _ in range(steps):
        last = cut(hops.join(last, "v", "left_semi").select(F.col("n").alias("v")).distinct().join(found, "v", "left_anti"))
        found = found.unionByName(last)
    return found


def both_ways(forward: DataFrame, backward: DataFrame) -> DataFrame:
    """Each backward walk of a root continued by each forward one, the root once: ``entity, root_idx, walk``."""
    before = backward.select("entity", F.col("walk").alias("back"))
    joined = forward.join(before, "entity")
    return joined.select("entity", (F.size("back") - 1).alias("root_idx"), F.expr("concat(slice(back, 1, size(back) - 1), walk)").alias("walk"))


def with_root(walks: DataFrame) -> DataFrame:
    return walks.select("entity", F.lit(0).alias("root_idx"), "walk")
