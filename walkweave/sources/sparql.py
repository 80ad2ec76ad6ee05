"""SPARQL endpoints: queries as text, a connector, and graphs that are fetched a level at a time."""

from __future__ import annotations

import json
import os
import time
from collections import OrderedDict
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from urllib.error import URLError
from urllib.parse import urlencode
from urllib.request import Request, urlopen

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from walkweave.graph import KnowledgeGraph
from walkweave.spark import cut

HEADERS = {"Accept": "application/sparql-results+json"}


def hops_query(entity: str, predicates: Sequence[str] = ()) -> str:
    """The query for an entity's hops, or for what lies at the end of a chain of predicates."""
    if not predicates:
        return f"SELECT ?p ?o WHERE {{ <{entity}> ?p ?o . }}"
    nodes = [f"<{entity}>", *[f"?o{i}" for i in range(1, len(predicates))], "?o"]
    steps = " ".join(f"{a} <{p}> {b} ." for a, p, b in zip(nodes, predicates, nodes[1:]))
    return f"SELECT ?o WHERE {{ {steps} }}"


def reverse_query(entity: str) -> str:
    return f"SELECT ?s ?p WHERE {{ ?s ?p <{entity}> . }}"


def ask_query(entity: str) -> str:
    return f"ASK WHERE {{ <{entity}> ?p ?o . }}"


def is_web(name: str) -> bool:
    return name.startswith(("http://", "https://"))


def is_valid_url(url: str, timeout: float = 10) -> bool:
    """Whether an endpoint answers a trivial question."""
    try:
        with urlopen(Request(f"{url}/query?{urlencode({'query': 'ASK {}'})}", method="HEAD", headers=HEADERS), timeout=timeout) as answer:
            return answer.status == 200
    except (URLError, ValueError, OSError):
        return False


def check_location(location: str) -> None:
    """An endpoint must answer (ValueError), a local path must be a file (FileNotFoundError)."""
    if is_web(location):
        if not is_valid_url(location):
            raise ValueError(f"{location} is no SPARQL endpoint that answers")
    elif "://" not in location and not os.path.isfile(location):
        raise FileNotFoundError(location)


class SPARQLConnector:
    """Asks an endpoint; ``fetch_all`` asks several questions at once.  Answers are JSON, parsed.

    The latest ``kept`` answers are kept for ``seconds``, in each process for
    itself; ``kept`` 0 keeps none.
    """

    def __init__(self, endpoint: str, threads: int = 8, timeout: float = 60, kept: int = 1024, seconds: float = 1200):
        self.endpoint, self.threads, self.timeout, self.kept, self.seconds = endpoint, threads, timeout, kept, seconds
        self._answers: OrderedDict[str, tuple[float, dict]] = OrderedDict()

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_answers": OrderedDict()}

    def fetch(self, query: str) -> dict:
        found = self._answers.get(query)
        if found and time.monotonic() - found[0] < self.seconds:
            return found[1]
        answer = self._ask(query)
        if self.kept:
            self._answers[query] = (time.monotonic(), answer)
            while len(self._answers) > self.kept:
                self._answers.popitem(last=False)
        return answer

    def _ask(self, query: str) -> dict:
        with urlopen(Request(f"{self.endpoint}/query?{urlencode({'query': query})}", headers=HEADERS), timeout=self.timeout) as answer:
            return json.load(answer)

    def fetch_all(self, queries: Sequence[str]) -> list[dict]:
        with ThreadPoolExecutor(self.threads) as pool:
            return list(pool.map(self.fetch, queries))


def hops_of(response: dict, skip: frozenset[str] = frozenset(), node: str = "o") -> list[tuple[str, str]]:
    """Predicates and nodes of an answer, without skipped predicates."""
    return [(b["p"]["value"], b[node]["value"]) for b in response["results"]["bindings"] if b["p"]["value"] not in skip]


BINDINGS = "struct<results:struct<bindings:array<struct<p:struct<value:string>,o:struct<value:string>>>>>"


def hops_of_json(answers: DataFrame) -> DataFrame:
    """Hops ``v, p, n`` of stored answers ``v, response`` (JSON text)."""
    bound = answers.select("v", F.explode(F.from_json("response", BINDINGS)["results"]["bindings"]).alias("b"))
    return bound.select("v", F.col("b.p.value").alias("p"), F.col("b.o.value").alias("n")).where("n IS NOT NULL")


def fetch_triples(names: DataFrame, connector: SPARQLConnector, reverse: bool = False, partitions: int | None = None) -> DataFrame:
    """``s, p, o`` around the names ``v`` that are web addresses; each task asks for its names, some at a time."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            own = [v for v in batch.column(0).to_pylist() if v and is_web(v)]
            answers = connector.fetch_all([reverse_query(v) if reverse else hops_query(v) for v in own])
            rows = [(s, p, v) if reverse else (v, p, s) for v, a in zip(own, answers) for p, s in hops_of(a, node="s" if reverse else "o")]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], names=["s", "p", "o"])

    asked = names.select("v").distinct()
    return (asked.repartition(partitions, "v") if partitions else asked).mapInArrow(run, "s string, p string, o string")


class RemoteGraph:
    """A graph behind an endpoint.

    Walkers get :meth:`around`: the local graph of what a number of hops from
    some entities reaches, fetched a level at a time, each vertex once.
    Existence and literals are asked for directly.

    ``connector`` may be any object with ``fetch_all`` (questions to parsed
    answers) that can be pickled; without one, a :class:`SPARQLConnector` with
    ``threads`` and the cache's ``kept`` and ``seconds`` is made.
    """

    is_remote = True

    def __init__(self, spark: SparkSession, endpoint: str, skip_predicates=(), literals: Sequence[Sequence[str]] = (), skip_verify: bool = False, threads: int = 8, connector=None, kept: int = 1024, seconds: float = 1200):
        if not skip_verify and connector is None:
            check_location(endpoint)
        self.spark, self.connector = spark, connector or SPARQLConnector(endpoint, threads, kept=kept, seconds=seconds)
        self.skip_predicates, self.literals = frozenset(skip_predicates), [list(c) for c in literals]

    def around(self, entities: DataFrame, depth: int, reverse: bool = False) -> KnowledgeGraph:
        at = cut(entities.select(F.col("entity").alias("v")).distinct())
        seen, found = at, self.spark.createDataFrame([], "s string, p string, o string")
        for _ in range(depth):
            came = cut(fetch_triples(at, self.connector, reverse).where(~F.col("p").isin(list(self.skip_predicates))) if self.skip_predicates else fetch_triples(at, self.connector, reverse))
            found = found.unionByName(came)
            at = cut(came.select(F.col("s" if reverse else "o").alias("v")).distinct().join(seen, "v", "left_anti"))
            seen = seen.union(at)
        return KnowledgeGraph(found, self.skip_predicates, self.literals, entities.select(F.col("entity").alias("v")))

    def exists(self, entities: DataFrame) -> DataFrame:
        """The distinct entities, each with whether the endpoint knows it as a subject."""
        connector = self.connector

        def run(batches):
            import pyarrow as pa

            for batch in batches:
                own = batch.column(0).to_pylist()
                answers = connector.fetch_all([ask_query(v) for v in own])
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.string()), pa.array([bool(a["boolean"]) for a in answers])], names=["entity", "exists"])

        return entities.select("entity").distinct().mapInArrow(run, "entity string, exists boolean")

    def is_exist(self, entities: DataFrame) -> bool:
        return self.exists(entities).where("NOT exists").isEmpty()

    def get_literals(self, entities: DataFrame) -> DataFrame:
        """Like a local graph's literals; every chain is one question for each entity."""
        from walkweave.functions.numbers import literal_value

        connector, chains = self.connector, self.literals

        def run(batches):
            import pyarrow as pa

            for batch in batches:
                asked = [(e, i) for e in batch.column(0).to_pylist() for i in range(len(chains))]
                answers = connector.fetch_all([hops_query(e, chains[i]) for e, i in asked if chains[i]])
                rest = iter(answers)
                texts = [sorted({b["o"]["value"] for b in next(rest)["results"]["bindings"]}) if chains[i] else [e] for e, i in asked]
                yield pa.RecordBatch.from_arrays([pa.array([e for e, _ in asked], pa.string()), pa.array([i for _, i in asked], pa.int32()), pa.array(texts, pa.list_(pa.string()))], names=["entity", "chain_idx", "texts"])

        sets = entities.select("entity").distinct().mapInArrow(run, "entity string, chain_idx int, texts array<string>")
        size = F.size("texts")
        kind = F.when(size == 0, "none").when(size == 1, "scalar").otherwise("tuple")
        return entities.select("pos", "entity").join(sets, "entity").select("pos", "entity", "chain_idx", kind.alias("kind"), F.transform("texts", literal_value).alias("values"))

