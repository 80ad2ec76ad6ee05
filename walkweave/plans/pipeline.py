"""The pipeline: walkers, an embedder, and what they have produced so far."""

from __future__ import annotations

import json
import logging
import time
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from walkweave.described import describe, rebuild
from walkweave.spark import cut, folders, remove

from .embedders import Embedder, Word2Vec
from .walkers import RandomWalker, Walker

log = logging.getLogger("walkweave")


def upsert(old: DataFrame, new: DataFrame, key: str | list[str] = "entity") -> DataFrame:
    """All rows of ``new``, and those of ``old`` whose key has none there."""
    keys = [key] if isinstance(key, str) else key
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


class WalkEmbedding:
    """Fits an embedder on the walks of entities, and keeps walks, entities, vectors and literals.

    ``verbose`` 1 logs counts, 2 also how long they took.
    """

    def __init__(self, embedder: Embedder | None = None, walkers: Sequence[Walker] | None = None, verbose: int = 0):
        if verbose not in (0, 1, 2):
            raise ValueError("verbose is 0, 1 or 2")
        self.embedder, self.walkers, self.verbose = embedder or Word2Vec(), list(walkers or [RandomWalker(2)]), verbose
        self.entities: DataFrame | None = None
        self.walk_store: DataFrame | None = None
        self.embeddings: DataFrame | None = None
        self.literals: DataFrame | None = None

    def get_walks(self, kg, entities: DataFrame, skip_verify: bool = False) -> DataFrame:
        """The walks of all walkers, one after another: ``walker_idx, entity, root_idx, walk``.

        ValueError if an entity is not in the graph.
        """
        start = time.perf_counter()
        if not skip_verify and not kg.is_exist(entities):
            raise ValueError("some entities are not in the graph")
        found = []
        for i, walker in enumerate(self.walkers):
            walks = walker.extract(kg, entities)
            found.append(walks.select(F.lit(i).alias("walker_idx"), "entity", "root_idx", "walk"))
        walks = cut(reduce(DataFrame.unionByName, found))
        self.walk_store = walks if self.walk_store is None else cut(upsert(self.walk_store, walks))
        self.entities = entities.select("pos", "entity") if self.entities is None else upsert(self.entities, entities.select("pos", "entity"))
        if self.verbose:
            log.info("%d walks of %d entities%s", walks.count(), entities.count(), self._since(start))
        return walks

    def _since(self, start: float) -> str:
        return f" in {time.perf_counter() - start:.1f} s" if self.verbose == 2 else ""

    def fit(self, kg, entities: DataFrame, is_update: bool = False, skip_verify: bool = False) -> WalkEmbedding:
        if not is_update:
            self.walk_store = self.entities = self.embeddings = self.literals = None
        walks = self.get_walks(kg, entities, skip_verify)
        start = time.perf_counter()
        self.embedder.fit(walks, is_update)
        if self.verbose:
            log.info("fitted%s", self._since(start))
        return self

    def transform(self, kg, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Vectors ``pos, entity, vector`` and literals of the entities."""
        vectors, literals = cut(self.embedder.transform(entities)), kg.get_literals(entities)
        self.embeddings = vectors if self.embeddings is None else upsert(self.embeddings, vectors)
        self.literals = literals if self.literals is None else upsert(self.literals, literals)
        return vectors, literals

    def fit_transform(self, kg, entities: DataFrame, is_update: bool = False, skip_verify: bool = False) -> tuple[DataFrame, DataFrame]:
        return self.fit(kg, entities, is_update, skip_verify).transform(kg, entities)

    PARTS = ("entities", "walk_store", "embeddings", "literals")

    def save(self, path: str) -> None:
        """A new version below the folder: Parquet tables, what the embedder has learned, and all parameters as JSON.

        A version counts once its list of contents is written, which comes last;
        only then do older versions go.  So a pipeline can be saved where it was
        loaded from, and a failed attempt leaves what was there.
        """
        spark = (self.walk_store or self.entities).sparkSession
        about = json.dumps({"kind": type(self).__name__, "verbose": self.verbose, "embedder": describe(self.embedder), "walkers": [describe(w) for w in self.walkers], "parts": [n for n in self.PARTS if getattr(self, n) is not None]})
        old = _versions(spark, path)
        to = f"{path}/v{max([*old, 0]) + 1:06}"
        remove(spark, to)
        for name in self.PARTS:
            if getattr(self, name) is not None:
                getattr(self, name).write.parquet(f"{to}/{name}")
        self.embedder.save_state(f"{to}/embedder")
        spark.createDataFrame([(about,)], "value string").coalesce(1).write.text(f"{to}/about")
        self._read(spark, to, json.loads(about)["parts"])
        for number in old:
            remove(spark, f"{path}/v{number:06}")

    def _read(self, spark: SparkSession, folder: str, parts: list[str]) -> None:
        for name in parts:
            setattr(self, name, spark.read.parquet(f"{folder}/{name}"))
        self.embedder.load_state(spark, f"{folder}/embedder", self.walk_store)

    @classmethod
    def load(cls, spark: SparkSession, path: str, embedder: Embedder | None = None, walkers: Sequence[Walker] | None = None) -> WalkEmbedding:
        """The pipeline saved at a path, ready to go on; ValueError if what is there is something else.

        Embedder and walkers are made anew from their parameters unless others are given.
        """
        try:
            folder = f"{path}/v{max(_versions(spark, path)):06}"
            about = json.loads(spark.read.text(f"{folder}/about").first()[0])
            if about["kind"] != cls.__name__:
                raise ValueError(about["kind"])
        except Exception as error:
            raise ValueError(f"{path} holds no saved pipeline") from error
        made = cls(embedder or rebuild(about["embedder"], Embedder), walkers or [rebuild(w, Walker) for w in about["walkers"]], about["verbose"])
        made._read(spark, folder, about["parts"])
        return made


def _versions(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the complete versions below a folder."""
    return [int(n[1:]) for n in folders(spark, path) if n[0] == "v" and n[1:].isdigit() and "_SUCCESS" in folders(spark, f"{path}/{n}/about")]
