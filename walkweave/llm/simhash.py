"""SimHash near-duplicates: pigeonhole blocks bring close fingerprints together, Hamming distance verifies.

A fingerprint of 64 bits is cut into ``blocks`` blocks.  Two fingerprints that
differ in ``distance`` bits agree on at least ``blocks - distance`` blocks, so
they meet under one of the keys made of that many blocks.  Equal fingerprints
are one node from the start.  A key with many fingerprints is dealt out as pairs
of chunks, and each pair of chunks gives a spanning forest of its links, not all
of them, so that neither a task nor the links grow with the square of a group.

Edge cases: a null text and a text without words have fingerprint zero, which
links like any other; texts of any length count whole; repeated rows are
repeated; a null id is never the smallest (a group of null ids alone has a null
``component_id``); extra columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_values, checkpointed, map_rows, texts
from .components import components

_hash = xxhash.xxh64_intdigest


def majority(hashes: list[int] | np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[at : at + (1 << 16)], "<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(data: bytes | None, size: int = 3, seed: int = 42) -> int:
    """The fingerprint of a text's shingles of ``size`` words (A-Z lower-cased), as an unsigned number."""
    words = data.lower().split() if data else []
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) < size:
        hashes = [_hash(line, seed)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        hashes = [_hash(line[a:b], seed) for a, b in zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist())]
    return majority(hashes)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """``doc_id, fp, h``: the fingerprint as a signed number, and a hash of the text."""

    def make():
        def step(batch: pa.RecordBatch):
            yield [batch.column(0).to_pylist(), [_signed(fingerprint(x, size)) for x in byte_values(batch.column(1))], batch.column(2).to_pylist()]

        return step

    hashed = F.xxhash64(F.col(f"`{text_col}`").cast("string"))
    return map_rows(texts(docs, id_col, text_col, hashed), [("doc_id", pa.int64()), ("fp", pa.int64()), ("h", pa.int64())], make)


def _forest(prints: np.ndarray, left: np.ndarray, right: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links between ``prints[left]`` and ``prints[right]`` that join what the close pairs among them join."""
    parent = list(range(len(prints)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for i in left.tolist():
        for j in right[np.bitwise_count(prints[right] ^ prints[i]) <= distance].tolist():
            a, b = root(i), root(j)
            if a != b:
                parent[a] = b
                out.append((i, j))
    return out


def links(prints: DataFrame, distance: int = 3, blocks: int = 5, chunk: int = 1024) -> DataFrame:
    """``a, b``: links among distinct fingerprints ``fp`` that connect all that lie within ``distance`` bits of each other."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    masks = [sum(((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in kept) for kept in combinations(range(blocks), blocks - distance)]
    keys = F.array(*[F.struct(F.lit(t).cast("int").alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for t, m in enumerate(masks)])
    keyed = prints.select("fp", F.explode(keys).alias("k")).select("fp", "k.t", "k.key")
    sizes = keyed.groupBy("t", "key").agg(F.count("fp").alias("n")).where("n > 1")
    chunks = F.ceil(F.col("n") / chunk).cast("int")
    own = F.pmod(F.xxhash64("fp"), chunks).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), chunks - 1), lambda x: F.struct(F.least(own, x).alias("c"), F.greatest(own, x).alias("d"), own.alias("own")))
    dealt = keyed.join(sizes, ["t", "key"]).select("fp", "t", "key", F.explode(pairs).alias("p")).select("t", "key", "p.c", "p.d", "p.own", "fp")
    dealt = dealt.repartition("t", "key", "c", "d").sortWithinPartitions("t", "key", "c", "d")

    def run(batches):
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        rest = None

        def close(group: np.ndarray):
            c, d, own, fp = group[:, 2], group[:, 3], group[:, 4], group[:, 5].astype(np.uint64)
            left, right = np.flatnonzero(own == c), np.flatnonzero(own == d)
            return [(int(group[i, 5]), int(group[j, 5])) for i, j in _forest(fp, left, right, distance)]

        def several(rows: np.ndarray):
            cuts = np.flatnonzero((rows[1:, :4] != rows[:-1, :4]).any(axis=1)) + 1
            return [link for group in np.split(rows, cuts) for link in close(group)]

        def batch_of(found):
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], schema=schema)

        for batch in batches:
            rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], axis=1)
            rows = rows if rest is None else np.concatenate((rest, rows))
            if not len(rows):
                continue
            whole = np.flatnonzero((rows[:, :4] != rows[-1, :4]).any(axis=1))
            cut = int(whole[-1]) + 1 if len(whole) else 0
            rest = rows[cut:]
            if cut:
                yield batch_of(several(rows[:cut]))
        if rest is not None and len(rest):
            yield batch_of(several(rest))

    return dealt.mapInArrow(run, "a bigint, b bigint")


def _grouped(prints: DataFrame, distance: int, blocks: int) -> DataFrame:
    """``fp, component_id`` for every distinct fingerprint."""
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(links(nodes, distance, blocks))
    placed = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    firsts = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    return placed.select("fp", "root").join(firsts, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, distance: int = 3, blocks: int = 5) -> DataFrame:
    """Each document's group: ``doc_id, fingerprint, component_id``."""
    prints = checkpointed(fingerprints(docs, id_col, text_col, size))
    groups = _grouped(prints, distance, blocks)
    return prints.join(groups, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, distance: int = 3, blocks: int = 5) -> DataFrame:
    """One row of each group, that of the smallest id, with all its columns.

    Of rows that share this id the one whose text has the smallest hash stays,
    and of rows equal in both, any one.  Null ids come last.
    """
    prints = checkpointed(fingerprints(docs, id_col, text_col, size))
    roots = _grouped(prints, distance, blocks).select("fp", "root")
    first = prints.join(roots, "fp").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("k"))
    kept = first.select(F.col("k.doc_id").alias("__kept_id"), F.col("k.h").alias("__kept_h"))
    marked = docs.withColumn("__h", F.xxhash64(F.col(f"`{text_col}`").cast("string")))
    same = F.col(f"`{id_col}`").cast("bigint").eqNullSafe(F.col("__kept_id")) & (F.col("__h") == F.col("__kept_h"))
    rows = marked.join(kept, same, "left_semi")
    if prints.groupBy("doc_id", "h").count().where("count > 1").take(1):  # else the texts need not be moved once more
        rows = rows.dropDuplicates([id_col, "__h"])
    return rows.drop("__h")
