"""Literals at the end of predicate chains."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from walkweave.functions.numbers import literal_value
from walkweave.graph import KnowledgeGraph


def chain_ends(kg: KnowledgeGraph, entities: DataFrame, chain: Sequence[str]) -> DataFrame:
    """What each distinct entity reaches along a chain of predicates, as a set: ``entity, node``; an empty chain reaches itself."""
    at = entities.select("entity").distinct().select("entity", F.col("entity").alias("node"))
    for predicate in chain:
        step = kg.triples.where(F.col("p") == predicate).select(F.col("s").alias("node"), "o")
        at = at.join(step, "node").select("entity", F.col("o").alias("node")).distinct()
    return at


def literals(kg: KnowledgeGraph, entities: DataFrame, chains: Sequence[Sequence[str]] | None = None) -> DataFrame:
    """``pos, entity, chain_idx, kind, values``: a row for each entity and chain.

    ``kind`` is ``none``, ``scalar`` or ``tuple`` by the number of values, which
    are sorted as text; each is a number if Python's float() takes it.
    """
    chains = kg.literals if chains is None else chains
    if not chains:
        empty = "pos bigint, entity string, chain_idx int, kind string, values array<struct<num:double,str:string>>"
        return entities.sparkSession.createDataFrame([], empty)
    ends = reduce(DataFrame.unionByName, [chain_ends(kg, entities, c).withColumn("chain_idx", F.lit(i)) for i, c in enumerate(chains)])
    sets = ends.groupBy("entity", "chain_idx").agg(F.array_sort(F.collect_list("node")).alias("texts"))
    wanted = entities.select("pos", "entity", F.explode(F.sequence(F.lit(0), F.lit(len(chains) - 1))).alias("chain_idx"))
    rows = wanted.join(sets, ["entity", "chain_idx"], "left").withColumn("texts", F.coalesce("texts", F.array().cast("array<string>")))
    size = F.size("texts")
    kind = F.when(size == 0, "none").when(size == 1, "scalar").otherwise("tuple")
    return rows.select("pos", "entity", "chain_idx", kind.alias("kind"), F.transform("texts", literal_value).alias("values"))


def numbers(values: Column) -> Column:
    return F.filter(F.transform(values, lambda x: x["num"]), lambda x: x.isNotNull() & ~F.isnan(x))


def features(found: DataFrame) -> DataFrame:
    """Numbers that describe each row's values: ``pos, entity, chain_idx, n, has_any, least, greatest, total, mean, spread``."""
    rows = found.withColumn("x", numbers(F.col("values")))
    total = F.aggregate("x", F.lit(0.0), lambda a, b: a + b)
    mean = F.when(F.size("x") > 0, total / F.size("x"))
    square = F.aggregate("x", F.lit(0.0), lambda a, b: a + (b - mean) * (b - mean))
    return rows.select(
        "pos", "entity", "chain_idx", F.size("values").alias("n"), (F.size("values") > 0).alias("has_any"),
        F.array_min("x").alias("least"), F.array_max("x").alias("greatest"), total.alias("total"), mean.alias("mean"),
        F.when(F.size("x") > 0, F.sqrt(square / F.size("x"))).alias("spread"),
    )
