"""The knowledge graph: a set of triples, read forwards or backwards."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TRIPLE = "s string, p string, o string"
#: Up to so many skipped predicates become a filter (pushed into the scan), more a join.
MOST_IN_FILTER = 1_000


def entity_frame(spark: SparkSession, entities: Iterable[str]) -> DataFrame:
    """``pos, entity`` of a list; repeated entities keep their places."""
    return spark.createDataFrame(list(enumerate(entities)), "pos bigint, entity string")


class KnowledgeGraph:
    """Distinct triples ``s, p, o``; every term is its text, so an IRI and a literal of the same text are one vertex.

    ``skip_predicates`` drops triples by exact predicate, before anything else
    sees them; vertices of dropped triples alone do not exist.  ``literals`` are
    predicate chains for :meth:`get_literals`.  Instances don't change: adding
    and removing give new graphs.  ``repeated`` are the same triples, some
    perhaps more than once, for what counts none: a source may have them without
    dealing any.
    """

    def __init__(self, triples: DataFrame, skip_predicates: Iterable[str] = (), literals: Sequence[Sequence[str]] = (), vertices: DataFrame | None = None, distinct: bool = False, repeated: DataFrame | None = None):
        skip = sorted(set(skip_predicates))

        def known(triples: DataFrame) -> DataFrame:
            rows = triples.select(*[F.col(c).cast("string").alias(c) for c in ("s", "p", "o")]).where("s IS NOT NULL AND p IS NOT NULL AND o IS NOT NULL")
            if len(skip) > MOST_IN_FILTER:
                dropped = triples.sparkSession.createDataFrame([(p,) for p in skip], "p string")
                return rows.join(dropped, "p", "left_anti").select("s", "p", "o")
            return rows.where(~F.col("p").isin(skip)) if skip else rows

        rows = known(triples)
        self.triples = rows if distinct else rows.distinct()
        self.repeated = self.triples if repeated is None else known(repeated)
        self.literals = [list(chain) for chain in literals]
        self.skip_predicates = frozenset(skip)
        self._more_vertices = vertices

    @classmethod
    def from_rows(cls, spark: SparkSession, rows: Iterable[tuple[str, str, str]], **options) -> KnowledgeGraph:
        return cls(spark.createDataFrame(list(rows), TRIPLE), **options)

    def _with(self, triples: DataFrame, vertices: DataFrame | None, distinct: bool) -> KnowledgeGraph:
        return KnowledgeGraph(triples, self.skip_predicates, self.literals, vertices, distinct)

    def add(self, triples: DataFrame) -> KnowledgeGraph:
        """The graph with more triples (those with skipped predicates stay out)."""
        return self._with(self.triples.unionByName(triples.select("s", "p", "o")), self._more_vertices, False)

    def add_vertices(self, names: DataFrame) -> KnowledgeGraph:
        """The graph with isolated vertices (column ``v``)."""
        more = names.select(F.col("v").cast("string").alias("v"))
        return KnowledgeGraph(self.triples, self.skip_predicates, self.literals, more if self._more_vertices is None else self._more_vertices.union(more), True, self.repeated)

    def remove(self, triples: DataFrame, keep_vertices: bool = False) -> KnowledgeGraph:
        """The graph without some triples, in both directions; their vertices can go on to exist."""
        rest = self.triples.join(triples.select("s", "p", "o"), ["s", "p", "o"], "left_anti")
        return self._with(rest, self.vertices() if keep_vertices else self._more_vertices, True)

    def persist(self, level: StorageLevel = StorageLevel.MEMORY_AND_DISK_DESER) -> KnowledgeGraph:
        """Keeps the triples at a storage level, for many walks over one graph."""
        self.triples = self.repeated = self.triples.persist(level)
        return self

    def unpersist(self) -> KnowledgeGraph:
        self.triples = self.repeated = self.triples.unpersist()
        return self

    def hops(self, reverse: bool = False) -> DataFrame:
        """One-step moves ``v, p, n``: along the triples, or against them."""
        v, n = ("o", "s") if reverse else ("s", "o")
        return self.triples.select(F.col(v).alias("v"), "p", F.col(n).alias("n"))

    def hops_of(self, name: str, reverse: bool = False) -> DataFrame:
        return self.hops(reverse).where(F.col("v") == name).select("p", "n")

    def neighbors(self, name: str, reverse: bool = False) -> DataFrame:
        """Neighbours of an entity on the graph whose predicates are vertices too: its triples."""
        return self.triples.where(F.col("o" if reverse else "s") == name)

    def vertices(self) -> DataFrame:
        """All entity vertices ``v``: subjects, objects and isolated ones."""
        both = self.repeated.select(F.explode(F.array("s", "o")).alias("v"))
        return (both if self._more_vertices is None else both.union(self._more_vertices)).distinct()

    def exists(self, entities: DataFrame) -> DataFrame:
        """The distinct entities, each with whether it is a vertex."""
        asked = entities.select("entity").distinct()
        return asked.join(self.vertices().withColumn("found", F.lit(True)), F.col("entity") == F.col("v"), "left").select("entity", F.coalesce("found", F.lit(False)).alias("exists"))

    def is_exist(self, entities: DataFrame) -> bool:
        return entities.select("entity").join(self.vertices(), F.col("entity") == F.col("v"), "left_anti").isEmpty()

    def get_literals(self, entities: DataFrame) -> DataFrame:
        from walkweave.operators.literals import literals

        return literals(self, entities)
