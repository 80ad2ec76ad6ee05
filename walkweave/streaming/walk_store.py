"""A graph and its walks kept in step under changes of the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from walkweave.graph import KnowledgeGraph
from walkweave.operators.upkeep import TERMS, changed_walks, divided
from walkweave.operators.walks import expand
from walkweave.spark import cut, folders, remove

_CHANGE = "s string, p string, o string, change int"
_TABLES = {"triples": _CHANGE, "roots": "entity string", "walks": "entity string, walk array<string>, change int"}


class WalkStore:
    """Below a folder: the triples, the roots, and the roots' walks of up to ``depth`` hops, as logs of changes.

    A change is a folder ``number=N`` in each log, with the triples and walks that
    come (1) and go (-1).  It counts once its mark in ``done`` is there, which is
    written last, so a failed attempt is overwritten by the next one; a change
    brought again changes nothing, as all of it is known.  What is there now is what
    has come more often than gone; :meth:`compact` writes that as one folder.  A
    store has one writer at a time and any number of readers.

    Null terms, repeated, known or unknown triples change nothing; what one
    change both removes and adds is there afterwards.
    """

    def __init__(self, spark: SparkSession, path: str, depth: int, reverse: bool = False):
        self.spark, self.path, self.depth, self.reverse = spark, path, depth, reverse

    @classmethod
    def create(cls, kg: KnowledgeGraph, roots: DataFrame, path: str, depth: int, reverse: bool = False) -> WalkStore:
        """The store of a graph's walks, in a folder that has none yet."""
        made = cls(roots.sparkSession, path, depth, reverse)
        if made.numbers():
            raise ValueError(f"{path} holds a store already")
        who = roots.select("entity").distinct()
        made._write("roots", 0, who)
        made._write("triples", 0, kg.triples.withColumn("change", F.lit(1)))
        known = KnowledgeGraph(roots.sparkSession.read.schema(_CHANGE).parquet(made._folder("triples", 0)), distinct=True)  # made once
        made._write("walks", 0, expand(known.hops(reverse), who, depth, reverse).withColumn("change", F.lit(1)))
        made._done(0, 0)
        return made

    def _folder(self, name: str, number: int) -> str:
        return f"{self.path}/{name}/number={number}"

    def _write(self, name: str, number: int, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(self._folder(name, number))

    def _done(self, number: int, base: int) -> None:
        """Marks a change as complete; reading begins at ``base``."""
        self.spark.createDataFrame([(base,)], "base bigint").coalesce(1).write.mode("overwrite").parquet(self._folder("done", number))

    def numbers(self) -> list[int]:
        """The numbers of complete changes."""
        return sorted(int(n[7:]) for n in folders(self.spark, f"{self.path}/done") if n.startswith("number=") and "_SUCCESS" in folders(self.spark, f"{self.path}/done/{n}"))

    def _base(self) -> int:
        """From which number on the logs are to be read."""
        numbers = self.numbers()
        if not numbers:
            raise ValueError(f"{self.path} holds no store")
        return self.spark.read.parquet(self._folder("done", numbers[-1])).first()[0]

    def _log(self, name: str) -> DataFrame:
        base = self._base()
        return self.spark.read.schema(_TABLES[name]).parquet(*[self._folder(name, n) for n in self.numbers() if n >= base])

    def graph(self) -> KnowledgeGraph:
        there = self._log("triples").groupBy(*TERMS).agg(F.sum("change").alias("n")).where("n > 0")
        return KnowledgeGraph(there.select(*TERMS), distinct=True)

    def roots(self) -> DataFrame:
        return self.spark.read.schema(_TABLES["roots"]).parquet(self._folder("roots", self._base()))

    def walks(self) -> DataFrame:
        """The walks that are there now: ``entity, walk``."""
        return self._log("walks").groupBy("entity", "walk").agg(F.sum("change").alias("n")).where("n > 0").select("entity", "walk")

    def apply(self, added: DataFrame, removed: DataFrame) -> DataFrame:
        """Brings a change of the graph to the store; gives what it does to the walks."""
        number = self.numbers()[-1] + 1
        kept, plus, minus = divided(self.graph(), added, removed)
        self._write("walks", number, changed_walks(kept, plus, minus, self.roots(), self.depth, self.reverse))
        self._write("triples", number, plus.withColumn("change", F.lit(1)).unionByName(minus.withColumn("change", F.lit(-1))))
        self._done(number, self._base())
        return self.spark.read.schema(_TABLES["walks"]).parquet(self._folder("walks", number))

    def compact(self) -> None:
        """Writes what is there now as one change, after which older folders go, but for their marks."""
        old = self.numbers()
        number = old[-1] + 1
        self._write("roots", number, self.roots())
        self._write("triples", number, self.graph().triples.withColumn("change", F.lit(1)))
        self._write("walks", number, self.walks().withColumn("change", F.lit(1)))
        self._done(number, number)
        for n in old:
            for name in _TABLES:
                remove(self.spark, self._folder(name, n))

    def follow(self, changes: DataFrame, checkpoint: str, once: bool = True) -> StreamingQuery:
        """Brings each micro-batch of a stream ``s, p, o, change`` (1 or -1; net within a batch) to the store."""

        def write(batch: DataFrame, _: int) -> None:
            net = cut(batch.groupBy(*TERMS).agg(F.sum("change").alias("n")))
            self.apply(net.where("n > 0"), net.where("n < 0"))

        writer = changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer).start()
