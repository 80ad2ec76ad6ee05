"""A star schema of orders as a knowledge graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from walkweave.graph import KnowledgeGraph


def _node(kind: str, key: str) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))


#: Predicate, table, subject (kind and key), object (kind and key; no kind: a literal).
EDGES = [
    ("in_region", "nation", ("nation", "n_nationkey"), ("region", "n_regionkey")),
    ("from_nation", "customer", ("customer", "c_custkey"), ("nation", "c_nationkey")),
    ("in_segment", "customer", ("customer", "c_custkey"), (None, "c_mktsegment")),
    ("based_in", "supplier", ("supplier", "s_suppkey"), ("nation", "s_nationkey")),
    ("placed_by", "orders", ("order", "o_orderkey"), ("customer", "o_custkey")),
    ("has_priority", "orders", ("order", "o_orderkey"), (None, "o_orderpriority")),
    ("contains", "lineitem", ("order", "l_orderkey"), ("part", "l_partkey")),
    ("shipped_by", "lineitem", ("order", "l_orderkey"), ("supplier", "l_suppkey")),
    ("has_brand", "part", ("part", "p_partkey"), (None, "p_brand")),
]
BALANCE = ("has_balance", "customer", ("customer", "c_custkey"), (None, "c_acctbal"))


def star_triples(spark: SparkSession, sf_dir: str, edges=None, repeated: bool = False) -> DataFrame:
    """Distinct triples of the tables, which lie by subject: each table is dealt once by it, and what asks for the hops of a vertex deals them no more.

    Each predicate reads only its two columns; those of order lines, whose
    subjects are no keys, share one pass.  ``repeated`` leaves rows where they
    are, with some triples more than once.
    """

    def name(obj: tuple) -> Column:
        return _node(*obj) if obj[0] else F.col(obj[1]).cast("string")

    def dealt(table: str, subject: tuple, objects: dict) -> DataFrame:
        rows = spark.read.parquet(f"{sf_dir}/{table}.parquet").select(_node(*subject).alias("s"), *[name(o).alias(p) for p, o in objects.items()])
        rows = rows.where("s IS NOT NULL")
        return rows if repeated else rows.repartition("s")

    def one(predicate: str, table: str, subject: tuple, obj: tuple) -> DataFrame:
        return dealt(table, subject, {predicate: obj}).select("s", F.lit(predicate).alias("p"), F.col(predicate).alias("o")).where("o IS NOT NULL")

    def lines(subject: tuple, objects: dict) -> DataFrame:
        each = F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.col(p).alias("o")) for p in objects]))
        rows = dealt("lineitem", subject, objects).select("s", each.alias("e")).select("s", "e.p", "e.o").where("o IS NOT NULL")
        return rows if repeated else rows.distinct()

    edges = list(edges or EDGES)
    found = [one(*e) for e in edges if e[1] != "lineitem"]
    by_subject: dict = {}
    for p, table, subject, obj in edges:
        if table == "lineitem":
            by_subject.setdefault(subject, {})[p] = obj
    found += [lines(subject, objects) for subject, objects in by_subject.items()]
    return reduce(DataFrame.unionByName, found)


def star_graph(spark: SparkSession, sf_dir: str, **options) -> KnowledgeGraph:
    edges = options.pop("edges", None)
    return KnowledgeGraph(star_triples(spark, sf_dir, edges), distinct=True, repeated=star_triples(spark, sf_dir, edges, True), **options)


def roots(spark: SparkSession, sf_dir: str, table: str, kind: str, key: str) -> DataFrame:
    """All keys of a table as entities."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(F.col(key).cast("bigint").alias("pos"), _node(kind, key).alias("entity"))
