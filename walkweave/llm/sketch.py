"""Count-min sketches of hashes, built over partitions and merged in Spark.

A sketch has a row of cells for each lane of the hashes.  Each task sends, for
each range of cells (a shard), the sorted cell numbers that its hashes fall into,
packed as differences; for each shard the tasks' parts are merged, and only the
bit "at least ``least``" of each cell goes to the driver.  The sketch's size is
set by ``bits`` alone.  Where data have more hashes than that has room for
(:func:`fits`), the sketch stays in its shards: :func:`repeated_cells` sends each
chunk of the data back those of its own cells that are hit again anywhere, and
:func:`found_in_chunks` looks its hashes up in a small sketch of these.  Nothing
then is as large as the data.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, checkpointed

_SHARD_BITS = 22
_CHUNK_BITS = 24
#: Chunks are dealt into so many partitions at most; a partition takes its chunks one after another.
_MOST_PARTITIONS = 20_000


def bits_for(hashes: int, most: int, cells_each: int = 4) -> int:
    """Bits of the cell numbers: about ``cells_each`` cells for each hash, within bounds."""
    return max(16, min(most, round(math.log2(max(2, cells_each * hashes)))))


def fits(hashes: int, most: int, cells_each: float = 4.5) -> bool:
    """Whether a sketch of ``most`` bits has ``cells_each`` cells for each hash."""
    return cells_each * hashes <= 1 << most


class Sketch:
    def __init__(self, bits: int, planes: list[np.ndarray]):
        self.bits, self.planes = bits, planes

    def holds(self, *lanes: np.ndarray) -> np.ndarray:
        """Which hashes (one uint64 array a lane) fall into set cells in all rows."""
        out = np.ones(len(lanes[0]), bool)
        for plane, lane in zip(self.planes, lanes):
            cell = lane >> np.uint64(64 - self.bits)
            out &= (plane[(cell >> np.uint64(3)).astype(np.int64)] >> (cell & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return out


def _pack(cells: np.ndarray) -> bytes:
    """Sorted cell numbers as differences: the low bytes as they are, the others deflated."""
    steps = np.diff(cells, prepend=np.uint32(0)).astype("<u4").view(np.uint8).reshape(-1, 4).T
    return len(cells).to_bytes(4, "little") + steps[0].tobytes() + zlib.compress(steps[1:].tobytes(), 1)


def _unpack(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:4], "little")
    steps = np.empty((n, 4), np.uint8)
    steps[:, 0] = np.frombuffer(data, np.uint8, n, 4)
    steps[:, 1:] = np.frombuffer(zlib.decompress(data[4 + n :]), np.uint8).reshape(3, n).T
    return np.cumsum(steps.view("<u4").ravel(), dtype=np.int64)


def build(df: DataFrame, hashes: Callable[[pa.RecordBatch], Iterator[tuple[np.ndarray, ...]]], bits: int, least: int = 2, lanes: int = 2, flush: int = 2_000_000) -> Sketch:
    """The sketch of all hashes that the function finds in the rows of ``df``; ``least`` is 1 or 2."""
    bounded_batches(df.sparkSession)
    shard_bits = min(bits, _SHARD_BITS)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def packed() -> pa.RecordBatch:
            rows, shards, data = [], [], []
            for row in range(lanes):
                cells = np.sort((np.concatenate([h[row] for h in held]) >> np.uint64(64 - bits)).astype(np.uint32))
                if least == 1:
                    cells = np.unique(cells)
                shard = cells >> np.uint32(shard_bits)
                cuts = np.concatenate(([0], np.flatnonzero(shard[1:] != shard[:-1]) + 1, [len(cells)]))
                for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                    rows.append(row)
                    shards.append(int(shard[a]))
                    data.append(_pack(cells[a:b] & np.uint32((1 << shard_bits) - 1)))
            held.clear()
            return pa.RecordBatch.from_pydict({"row": pa.array(rows, pa.int32()), "shard": pa.array(shards, pa.int32()), "data": pa.array(data, pa.binary())})

        size = 0
        for batch in batches:
            for found in hashes(batch):
                if len(found[0]):
                    held.append(found)
                    size += len(found[0])
                if size >= flush:
                    yield packed()
                    size = 0
        if held:
            yield packed()

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, once, twice = None, None, None

        def done() -> pa.RecordBatch:
            full = twice if least == 2 else once
            return pa.RecordBatch.from_pydict({"row": pa.array([at[0]], pa.int32()), "shard": pa.array([at[1]], pa.int32()), "data": pa.array([np.packbits(full, bitorder="little").tobytes()], pa.binary())})

        for batch in batches:
            for row, shard, data in zip(*(c.to_pylist() for c in batch.columns)):
                if at != (row, shard):
                    if at is not None:
                        yield done()
                    at, once, twice = (row, shard), np.zeros(1 << shard_bits, bool), np.zeros(1 << shard_bits, bool)
                cells = _unpack(data)
                if least == 2:
                    twice[cells[1:][cells[1:] == cells[:-1]]] = True
                    twice[cells] |= once[cells]
                once[cells] = True
        if at is not None:
            yield done()

    schema = "row int, shard int, data binary"
    sent = df.mapInArrow(parts, schema).repartition("row", "shard").sortWithinPartitions("row", "shard")
    ready = checkpointed(sent.mapInArrow(merged, schema))  # so many bytes as the sketch has
    planes = [np.zeros(1 << max(0, bits - 3), np.uint8) for _ in range(lanes)]
    step = 1 << (shard_bits - 3)
    for row, shard, data in ready.toLocalIterator():  # the driver holds one partition beside the planes
        planes[row][shard * step : (shard + 1) * step] = np.frombuffer(data, np.uint8)
    return Sketch(bits, planes)


def chunked(rows: DataFrame, chunk_bytes: int) -> DataFrame:
    """``chunk, data``: rows ``key, doc_id, text, ...`` whose texts have about so many bytes together, as compressed Arrow streams.

    A text lies in one chunk as a whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, at = [], 0, TaskContext.get().partitionId() << 32

        def row() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                for part in held:
                    out.write_batch(part)
            held.clear()
            return pa.RecordBatch.from_pydict({"chunk": pa.array([at], pa.int64()), "data": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

        for batch in batches:
            ends = np.cumsum(pc.binary_length(batch.column(2)).to_numpy(zero_copy_only=False).astype(np.int64))
            start = 0
            while start < batch.num_rows:
                before = int(ends[start - 1]) if start else 0
                stop = min(batch.num_rows, int(np.searchsorted(ends, before + chunk_bytes - size)) + 1)
                held.append(batch.slice(start, stop - start))
                size += int(ends[stop - 1]) - before
                start = stop
                if size >= chunk_bytes:
                    yield row()
                    size, at = 0, at + 1
        if held:
            yield row()

    return rows.mapInArrow(run, "chunk bigint, data binary")


def by_chunk(rows: DataFrame, chunks: DataFrame, *order: str) -> DataFrame:
    """Rows with a ``chunk``, those of one chunk together and in order."""
    return rows.repartition(max(1, min(chunks.count(), _MOST_PARTITIONS)), "chunk").sortWithinPartitions("chunk", *order)


def _shard_bits(bits: int) -> int:
    """Wider shards for wide sketches, so that a chunk's parts don't become too small."""
    return min(bits, max(_SHARD_BITS, min(25, bits - 9)))


def repeated_cells(chunks: DataFrame, hashes: Callable[[bytes], tuple[np.ndarray, np.ndarray]], bits: int) -> DataFrame:
    """``chunk, row, shard, data``: of each chunk's cells, those that all hashes together hit at least twice.

    ``chunks`` has the columns ``chunk, data``; the function returns the two lanes
    of a chunk's hashes.  A chunk sends a cell twice at most, so a shard gets no
    more than that from it however frequent a hash is.
    """
    bounded_batches(chunks.sparkSession)
    shard_bits = _shard_bits(bits)
    names = ["chunk", "row", "shard", "data"]
    kinds = pa.int64(), pa.int32(), pa.int32(), pa.binary()

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=names)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = []
                for row, lane in enumerate(hashes(data.as_buffer())):
                    cells = np.sort(lane >> np.uint64(64 - bits))
                    cells = cells[np.concatenate((np.ones(min(2, len(cells)), bool), cells[2:] != cells[:-2]))]
                    shard = (cells >> np.uint64(shard_bits)).astype(np.int64)
                    cuts = np.concatenate(([0], np.flatnonzero(shard[1:] != shard[:-1]) + 1, [len(cells)]))
                    low = (cells & np.uint64((1 << shard_bits) - 1)).astype(np.uint32)
                    rows += [(chunk, row, int(shard[a]), _pack(low[a:b])) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()) if a < b]
                if rows:
                    yield batch_of(rows)

    def returned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def answers() -> Iterator[pa.RecordBatch]:
            once, twice = np.zeros(1 << shard_bits, bool), np.zeros(1 << shard_bits, bool)
            for _, cells in held:
                twice[cells[1:][cells[1:] == cells[:-1]]] = True
                twice[cells] |= once[cells]
                once[cells] = True
            rows = []
            for chunk, cells in held:
                again = np.unique(cells[twice[cells]])
                if len(again):
                    rows.append((chunk, *at, _pack(again)))
                if len(rows) == 1000:
                    yield batch_of(rows)
                    rows = []
            held.clear()
            if rows:
                yield batch_of(rows)

        for batch in batches:
            for chunk, row, shard, data in zip(*(c.to_pylist() for c in batch.columns)):
                if at != (row, shard):
                    if held:
                        yield from answers()
                    at = (row, shard)
                held.append((chunk, _unpack(data).astype(np.uint32)))
        if held:
            yield from answers()

    schema = "chunk bigint, row int, shard int, data binary"
    return chunks.mapInArrow(parts, schema).repartition("row", "shard").sortWithinPartitions("row", "shard").mapInArrow(returned, schema)


def found_in_chunks(chunks: DataFrame, cells: DataFrame, bits: int, find: Callable[[bytes, Sketch], Iterator[pa.RecordBatch]], schema: str, own: bool = False) -> DataFrame:
    """What the function finds in each chunk, given a sketch that holds all of its hashes whose cells are in ``cells``.

    Of the chunk's other hashes the sketch holds few: it has some ten cells for each hash.
    With ``own``, rows begin with their ``chunk``.
    """
    shard_bits, own_bits, lanes = _shard_bits(bits), min(bits, _CHUNK_BITS), 2
    last = chunks.select("chunk", F.lit(lanes).alias("row"), F.lit(0).alias("shard"), "data")
    rows = by_chunk(cells.union(last), chunks, "row", "shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = None
        for batch in batches:
            for chunk, row, shard, data in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3)):
                if planes is None:
                    planes = [np.zeros(1 << own_bits, bool) for _ in range(lanes)]
                if row < lanes:
                    planes[row][(_unpack(data.as_py()) | shard << shard_bits) >> (bits - own_bits)] = True
                else:
                    sketch = Sketch(own_bits, [np.packbits(p, bitorder="little") for p in planes])
                    planes = None
                    for found in find(data.as_buffer(), sketch):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(found.num_rows, chunk), pa.int64()), *found.columns], names=["chunk", *found.schema.names]) if own else found

    return rows.mapInArrow(run, f"chunk bigint, {schema}" if own else schema)


def of_column(df: DataFrame, names: list[str], bits: int) -> Sketch:
    """The sketch that holds all values of bigint columns, one a lane, which are hashes already."""

    def hashes(batch: pa.RecordBatch):
        yield tuple(c.to_numpy(zero_copy_only=False).view(np.uint64) for c in batch.columns)

    return build(df.select(*names), hashes, bits, least=1, lanes=len(names))
