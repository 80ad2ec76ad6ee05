"""Graphs and entities from files, whatever their format."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from walkweave.graph import KnowledgeGraph
from walkweave.operators.ids import dense_ids

from . import ntriples, rdf, split_turtle


def read_triples(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """``s, p, o`` of RDF files; ``kind`` (nt, xml, turtle, json-ld, parquet) is told by the name where not given."""
    kind = kind or ("parquet" if path.rstrip("/").endswith(".parquet") else rdf.format_of(path))
    if kind == "parquet":
        return spark.read.parquet(path).select("s", "p", "o")
    if kind == "turtle":
        return split_turtle.read_turtle(spark, path)
    return ntriples.read(spark, path) if kind == "nt" else rdf.read(spark, path, kind)


def load_graph(spark: SparkSession, location: str, kind: str | None = None, skip_verify: bool = False, **options):
    """The graph at a location: an endpoint, or files."""
    from .sparql import RemoteGraph, check_location, is_web

    if is_web(location):
        return RemoteGraph(spark, location, skip_verify=skip_verify, **options)
    if not skip_verify and "://" not in location and not location.endswith("/"):
        check_location(location)
    return KnowledgeGraph(read_triples(spark, location, kind), **options)


def read_entities(spark: SparkSession, path: str, column: str) -> DataFrame:
    """``pos, entity`` and the other columns of a tab-separated table with a header; ``pos`` counts its rows from 0."""
    rows = spark.read.option("sep", "\t").option("header", True).csv(path)
    ordered = rows.withColumn("__place", F.monotonically_increasing_id())
    return dense_ids(ordered, ["__place"], "pos").drop("__place").withColumnRenamed(column, "entity")
