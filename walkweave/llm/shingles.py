"""Near-duplicates by the similarity of word shingles: SimHash and minhash bands bring texts together, whole shingle sets decide.

Two texts are linked if their sets of shingles of ``size`` words (A-Z
lower-cased) have a Jaccard similarity of ``least`` or more; links make groups.
Candidates come from two steps.  SimHash: texts whose fingerprints (of their sets
of shingles) differ in at most ``distance`` bits, by pigeonhole blocks and Hamming
verification; none within that distance is lost, but two texts of similarity 0.8
differ in about 10 bits of 64, which blocks can't reach.  So bands widen these: a
text has ``bands`` keys of ``rows`` minima each, and texts that share a key are
candidates too; two texts of similarity s share none with probability
(1 - s^rows)^bands, which is 1e-4 at 0.8 and under 1e-9 at 0.9.  Candidates are
compared exactly, within their component; a component with many texts is dealt
out as pairs of chunks, each giving a spanning forest of its links.

Edge cases: a text of fewer words is one shingle; texts without words (null,
empty, blank) are alike; texts of any length count whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import byte_values, checkpointed, map_rows, stored
from .components import components

_hash = xxhash.xxh64_intdigest


def shingles(data: bytes | None, size: int = 5, seed: int = 42) -> np.ndarray:
    """The distinct hashes of a text's shingles, in order; those of a text without words are that of nothing."""
    words = data.lower().split() if data else []
    line = b" ".join(words)
    if len(words) <= size:
        return np.array([_hash(line, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    found = [_hash(line[a:b], seed) for a, b in zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist())]
    return np.unique(np.array(found, np.uint64))


def _factors(n: int) -> np.ndarray:
    """``n`` odd numbers, always the same."""
    return np.array([_hash(b"%d" % i, 7) & 0xFFFFFFFF | 1 for i in range(n)], np.uint32)


def band_keys(found: np.ndarray, factors: np.ndarray, bands: int) -> list[int]:
    """A key for each band: a hash of the band's number and of its minima."""
    short = (found >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(factors), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(short), 256):
        least = np.minimum(least, (short[at : at + 256, None] * factors).min(axis=0))
    return [_hash(x.tobytes(), b) - (1 << 63) for b, x in enumerate(least.reshape(bands, -1))]


def _keyed(docs: DataFrame, text_col: str, size: int, bands: int, rows: int) -> DataFrame:
    def make():
        factors = _factors(bands * rows)

        def step(batch: pa.RecordBatch):
            prints, keys = [], []
            for x in byte_values(batch.column(2)):
                found = shingles(x, size)
                prints.append(simhash._signed(simhash.majority(found)))
                keys.append(band_keys(found, factors, bands))
            yield [batch.column(0).to_pylist(), batch.column(1).to_pylist(), prints, keys]

        return step

    text = F.col(f"`{text_col}`").cast("string")
    fields = [("doc_id", pa.int64()), ("h", pa.int64()), ("fp", pa.int64()), ("keys", pa.list_(pa.int64()))]
    return map_rows(docs.select(F.col("__id").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text")), fields, make)


def close_prints(prints: DataFrame, distance: int, blocks: int) -> DataFrame:
    """``a, b``: links among texts (by hash) that connect all whose fingerprints lie within ``distance`` bits of each other."""
    nodes = checkpointed(prints.groupBy("fp").agg(F.min("h").alias("first")))
    ends = [nodes.select(F.col("fp").alias(end), F.col("first").alias(f"first_{end}")) for end in ("a", "b")]
    apart = simhash.links(nodes.select("fp"), distance, blocks).join(ends[0], "a").join(ends[1], "b").select(F.col("first_a").alias("a"), F.col("first_b").alias("b"))
    equal = prints.join(nodes, "fp").where("h <> first").select(F.col("h").alias("a"), F.col("first").alias("b"))
    return equal.union(apart)


def similar(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Links between ``sets[left]`` and ``sets[right]`` that join what the similar pairs among them join."""
    parent = list(range(len(sets)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    counts = np.array([len(s) for s in sets])
    held = np.repeat(right, counts[right])
    values = np.concatenate([sets[j] for j in right.tolist()])
    order = np.argsort(values, kind="stable")
    held, values = held[order], values[order]
    out, apart = [], len(set(left.tolist()) | set(right.tolist()))
    for i in left.tolist():
        if apart == 1:
            break
        lo, hi = np.searchsorted(values, sets[i], "left"), np.searchsorted(values, sets[i], "right")
        n = hi - lo
        at = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        common = np.bincount(held[at], minlength=len(sets))
        for j in right[common[right] >= least * (counts[i] + counts[right] - common[right])].tolist():
            a, b = root(i), root(j)
            if a != b:
                parent[a] = b
                apart -= 1
                out.append((i, j))
    return out


def links(docs: DataFrame, candidates: DataFrame, text_col: str, size: int, least: float, chunk: int) -> DataFrame:
    """``a, b``: links among the texts (by hash) of each candidate component that connect all that are similar."""
    sizes = candidates.groupBy("root").agg(F.count("node").alias("n"))
    chunks = F.ceil(F.col("n") / chunk).cast("int")
    own = F.pmod(F.xxhash64("node"), chunks).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), chunks - 1), lambda x: F.struct(F.least(own, x).alias("c"), F.greatest(own, x).alias("d"), own.alias("own")))
    places = candidates.join(sizes, "root").select("node", "root", F.explode(pairs).alias("p")).select("node", "root", "p.c", "p.d", "p.own")
    text = F.col(f"`{text_col}`").cast("string")
    rows = docs.select(F.xxhash64(text).alias("node"), text.alias("text")).join(places, "node").select("root", "c", "d", "own", "node", "text")
    rows = rows.repartition("root", "c", "d").sortWithinPartitions("root", "c", "d", "node")

    def run(batches):
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        key, group = None, {}

        def found():
            nodes = list(group)
            c, d = key[1:]
            side = np.array([group[x][0] for x in nodes])
            left, right = np.flatnonzero(side == c), np.flatnonzero(side == d)
            if len(nodes) < 2 or not len(left) or not len(right):
                return []
            return [(nodes[i], nodes[j]) for i, j in similar([group[x][1] for x in nodes], left, right, least)]

        def batch_of(out):
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], schema=schema)

        for batch in batches:
            out = []
            for *at, own, node, text in zip(*(c.to_pylist() for c in batch.columns[:5]), byte_values(batch.column(5))):
                if at != key:
                    out += found() if group else []
                    key, group = at, {}
                if node not in group:  # copies are one text
                    group[node] = own, shingles(text, size)
            if out:
                yield batch_of(out)
        if group:
            yield batch_of(found())

    return rows.mapInArrow(run, "a bigint, b bigint")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, least: float = 0.8, distance: int = 3, blocks: int = 5, bands: int = 50, rows: int = 8, chunk: int = 512) -> DataFrame:
    """One row of each group, that of the smallest id, with all its columns.

    Of rows that share this id the one whose text has the smallest hash stays,
    and of rows equal in both, any one.  Null ids come last.
    """
    named = docs.withColumn("__id", F.col(f"`{id_col}`").cast("bigint"))
    prints = stored(_keyed(named, text_col, size, bands, rows))
    keyed = prints.select("h", F.explode("keys").alias("key"))
    firsts = keyed.groupBy("key").agg(F.min("h").alias("first"), F.max("h").alias("last")).where("first < last").select("key", "first")
    banded = keyed.join(firsts, "key").select(F.col("h").alias("a"), F.col("first").alias("b"))
    candidates = checkpointed(components(close_prints(prints.select("h", "fp"), distance, blocks).union(banded)))
    roots = components(links(docs, candidates, text_col, size, least, chunk)).select(F.col("node").alias("h"), "root")
    placed = prints.select("doc_id", "h").join(roots, "h", "left").withColumn("root", F.coalesce("root", "h"))
    first = placed.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("k"))
    kept = first.select(F.col("k.doc_id").alias("__kept_id"), F.col("k.h").alias("__kept_h"))
    marked = docs.withColumn("__h", F.xxhash64(F.col(f"`{text_col}`").cast("string")))
    same = F.col(f"`{id_col}`").cast("bigint").eqNullSafe(F.col("__kept_id")) & (F.col("__h") == F.col("__kept_h"))
    found = marked.join(kept, same, "left_semi")
    if prints.groupBy("doc_id", "h").count().where("count > 1").take(1):  # else the texts need not be moved once more
        found = found.dropDuplicates([id_col, "__h"])
    return found.drop("__h")
