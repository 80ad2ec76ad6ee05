"""Exact top-k search by ball trees: branch and bound on inner products.

Vectors are dealt to shards; each shard is a ball tree.  A ball with centre c
and radius r holds no vector whose inner product with q exceeds q.c + |q| r, so
the tree is searched best bound first and left once the bound falls below the
k-th score so far.  Shards are searched in waves (1, 3, 12, 48, ... of them);
each query takes its k-th score of all waves before into the next.

A task gets a shard's vectors, builds the tree once, and lets the queries go
through it a batch at a time; of very many queries each ``block_rows`` make a
group of their own.  A query goes to every shard: rows / every x shards copies.

Scores are exact whole numbers.  A score beyond 64 bits counts as the nearest
long, for the order too.

Edge cases: vectors that are null, or hold null or non-finite components, and
rows with a null id take no part; vectors of different lengths don't meet; rows
with the query's id are the query's own; of several query rows with one id the
one with the smallest vector asks; equal candidates each count; ties go to the
smaller id; extra columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bounded_batches, checkpointed

_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def _floats(matrix: np.ndarray) -> np.ndarray:
    """Doubles near whole numbers; infinite where they have no end."""
    if matrix.dtype != object:
        return matrix.astype(np.float64)
    return np.array([float(x) if abs(x) < 10**300 else (math.inf if x > 0 else -math.inf) for x in matrix.ravel().tolist()]).reshape(matrix.shape)


class BallTree:
    """Balls over whole-number vectors; leaves hold up to ``leaf`` of them.

    Vectors whose squares leave the range of doubles make one leaf without a bound.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = 256):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        self.centres: list[np.ndarray] = []
        self.radii: list[float] = []
        self.children: list[tuple[int, int] | None] = []
        self.members: list[np.ndarray] = []
        self.bounded = float(np.abs(_floats(vectors)).max(initial=0)) < 1e140
        if len(ids):
            self._build(np.arange(len(ids)), leaf)
        self.lowest = [int(self.ids[m[0]]) for m in self.members]

    def _build(self, rows: np.ndarray, leaf: int) -> int:
        points = _floats(self.vectors[rows]) if self.bounded else np.zeros((len(rows), self.vectors.shape[1]))
        centre = points.mean(axis=0)
        away = np.sqrt(((points - centre) ** 2).sum(axis=1))
        at = len(self.centres)
        self.centres.append(centre)
        self.radii.append(float(away.max()))
        self.members.append(rows)
        self.children.append(None)
        if len(rows) > leaf and self.radii[at] > 0:
            a = points[int(away.argmax())]
            b = points[int(((points - a) ** 2).sum(axis=1).argmax())]
            side = np.argsort(points @ (b - a), kind="stable")
            half = len(rows) // 2
            left, right = np.sort(rows[side[:half]]), np.sort(rows[side[half:]])
            self.children[at] = (self._build(left, leaf), self._build(right, leaf))
        return at

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Upper bounds of inner products, by query and ball, with room for rounding."""
        if not self.centres:
            return np.empty((len(queries), 0))
        q = _floats(queries)
        if not self.bounded or float(np.abs(q).max(initial=0)) >= 1e140:
            return np.full((len(queries), len(self.centres)), math.inf)
        c = np.array(self.centres)
        norms = np.sqrt((q * q).sum(axis=1))[:, None]
        bound = q @ c.T + norms * np.array(self.radii)
        return bound + 1e-9 * (norms * (np.sqrt((c * c).sum(axis=1)) + np.array(self.radii)) + 1)

    def search(self, query: np.ndarray, own: int, bounds: np.ndarray, k: int, least: float) -> list[tuple[int, int]]:
        """Scores and ids of the best ``k`` rows (but those with id ``own``) whose scores are ``least`` at least."""
        best: list[tuple[int, int]] = []  # a heap of (score, -id): the worst kept row first
        queue = [(-bounds[0], 0)] if len(bounds) else []
        while queue:
            bound, node = heapq.heappop(queue)
            kth = best[0][0] if len(best) == k else -math.inf
            if -bound < max(kth, least):
                break
            if len(best) == k and -bound < kth + 1e-6 and self.lowest[node] > -best[0][1]:
                continue  # at most ties, all with larger ids
            children = self.children[node]
            if children:
                for child in children:
                    heapq.heappush(queue, (-bounds[child], child))
                continue
            rows = self.members[node]
            scores = self.vectors[rows] @ query
            if scores.dtype == object:
                scores = np.array([max(_LEAST, min(_MOST, int(s))) for s in scores], object)
            for i in np.flatnonzero(scores >= max(kth, least)).tolist():
                row = (int(scores[i]), -int(self.ids[rows[i]]))
                if row[1] == -own:
                    continue
                if len(best) < k:
                    heapq.heappush(best, row)
                elif row > best[0]:
                    heapq.heapreplace(best, row)
        return [(s, -i) for s, i in sorted(best, reverse=True)]


def whole(flat: np.ndarray) -> np.ndarray:
    """floor(256 * x) of finite doubles, exactly: doubles where they hold it, else Python's whole numbers."""
    with np.errstate(over="ignore"):
        scaled = np.floor(256.0 * flat)
    if np.isfinite(scaled).all():
        return scaled
    return np.array([256 * int(x) if abs(x) >= 2**53 else math.floor(256 * x) for x in flat.tolist()], object)


def _objects(matrix: np.ndarray) -> np.ndarray:
    """A matrix of whole numbers as Python's, which have no end."""
    return matrix if matrix.dtype == object else np.array([int(x) for x in matrix.ravel().tolist()], object).reshape(matrix.shape)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Vectors as rows of whole numbers: doubles where the sums of products with any other such rows are exact, else Python's."""
    flat = whole(column.flatten().to_numpy(zero_copy_only=False)).reshape(len(column), dim)
    most = 0.0 if flat.dtype == object else float(np.abs(flat).max(initial=0))
    return _objects(flat) if most * most * max(1, dim) >= 2**52 else flat


def takes_part(column: Column) -> Column:
    """Whether a vector is there and all its components are finite."""
    return column.isNotNull() & F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def waves(shards: int) -> list[range]:
    """The shards in the order of their search: 1, then three times as many as before them, and so on."""
    out, at = [], 0
    while at < shards:
        out.append(range(at, min(shards, max(1, 4 * at))))
        at = out[-1].stop
    return out


def top_k(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, every: int = 50, shard_rows: int = 65_536, block_rows: int = 100_000) -> DataFrame:
    """The best ``k`` rows for each row whose id is divisible by ``every``: ``query_id, rank, vec_id, score``.

    A shard has ``shard_rows`` vectors, fewer where the session has more cores than there would be shards.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    vector = F.col(f"`{vector_col}`").cast("array<double>")
    base = vectors.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), vector.alias("v")).where("id IS NOT NULL").where(takes_part(F.col("v"))).withColumn("dim", F.size("v"))
    rows = base.count()
    small = max(1, min(shard_rows, 4096))
    shards = max(1, math.ceil(rows / shard_rows), min(spark.sparkContext.defaultParallelism, math.ceil(rows / small)))
    blocks = max(1, math.ceil(rows / every / block_rows))
    asking = base.where(F.col("id") % every == 0).groupBy("id", "dim").agg(F.min("v").alias("v"))
    asking = asking.groupBy("id").agg(F.min(F.struct("v", "dim")).alias("x")).select("id", "x.v", "x.dim")
    asking = checkpointed(asking.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")))
    own = base.withColumn("shard", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(shards)).cast("int"))
    key = ["shard", "dim", "block"]

    def search(batches):
        """Rows by shard, length and block: first the shard's vectors, then the queries."""
        schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
        at, tree, ids, held = None, None, [], []
        for batch in batches:
            place = np.stack([batch.column(c).to_numpy() for c in range(4)], axis=1)  # key, then whether it asks
            cuts = [0, *(np.flatnonzero((place[1:] != place[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
            out: list[tuple[int, int, int]] = []
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                *group, asks = place[a].tolist()
                if group != at:
                    at, tree, ids, held = group, None, [], []
                part, dim = batch.slice(a, b - a), group[1]
                if not asks:
                    ids.append(part.column(4).to_numpy())
                    held.append(_matrix(part.column(5), dim))
                    continue
                if not held:
                    continue
                queries = _matrix(part.column(5), dim)
                if tree is None:
                    fit = _objects if any(x.dtype == object for x in held) else (lambda x: x)
                    tree = BallTree(np.concatenate(ids), np.concatenate([fit(x) for x in held]))
                if tree.vectors.dtype != queries.dtype:
                    tree.vectors, queries = _objects(tree.vectors), _objects(queries)
                bounds = tree.bounds(queries)
                for i, (query, floor) in enumerate(zip(part.column(4).to_pylist(), part.column(6).to_pylist())):
                    # A k-th score at the lower end stands for all below it.
                    floor = -math.inf if floor is None or floor == _LEAST else floor
                    out += [(query, row, score) for score, row in tree.search(queries[i], query, bounds[i], k, floor)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], schema=schema)

    def found(wave: range, asked: DataFrame) -> DataFrame:
        here = own.where(F.col("shard").between(wave.start, wave.stop - 1))
        every_block = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))) if blocks > 1 else F.lit(0)
        held = here.withColumn("block", every_block).select(*key, F.lit(0).alias("asks"), "id", "v", F.lit(None).cast("bigint").alias("least"))
        asks = asked.withColumn("shard", F.explode(F.sequence(F.lit(wave.start), F.lit(wave.stop - 1)))).select(*key, F.lit(1).alias("asks"), "id", "v", "least")
        groups = min(2_000, 3 * len(wave) * blocks)  # more partitions than groups, as some share one
        both = held.unionByName(asks).repartition(groups, *key).sortWithinPartitions(*key, "asks", "id")
        return both.mapInArrow(search, "query_id bigint, vec_id bigint, score bigint")

    def best(rows: DataFrame) -> DataFrame:
        place = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return rows.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)

    top, asked = None, asking.withColumn("least", F.lit(None).cast("bigint"))
    order = waves(shards)
    for wave in order:
        came = found(wave, asked)
        top = best(came if top is None else top.drop("rank").unionByName(came))
        if wave is not order[-1]:
            top = checkpointed(top)
            kth = top.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("least"))
            asked = asking.join(kth, "id", "left")
    return top.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


#: The same search in DuckDB's SQL, over all pairs of queries and rows.
SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, v.vec_id, CAST(list_dot_product(q.v, v.v) AS BIGINT) AS score
  FROM v q JOIN v ON q.vec_id % 50 = 0 AND v.vec_id <> q.vec_id AND len(v.v) = len(q.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
