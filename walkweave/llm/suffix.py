"""Removal of long repeated byte strings, by prefix doubling over anchored positions.

Positions get ranks by doubling: the name of a string of 2n bytes comes from the
names of its halves, so that ranks at growing lengths need no comparison of
bytes.  To rank every position of every text in Spark would move several times
the input, so Spark ranks *anchors* for whole runs of positions.  With L the
length looked for and C = L // 2 + 1, the anchor of a position is the place of
the least C-byte name among the next L - C + 1 places.  It depends on the L bytes
from the position alone, so equal strings have equal anchors at equal distances;
and the positions that share an anchor are consecutive.

1. Anchors are ranked by their core of C bytes; a sketch of all cores lets those
   that are unique go.
2. The others are ranked by the whole string that their run of positions spans;
   where it repeats, every position of the run does.
3. What is left unsettled, one representative of each different string around a
   core, is ranked position by position at length L.  A core with many different
   strings is dealt out over groups, whose ranks Spark then joins.

Ranks are 128-bit names, which stand for the strings.  A sketch of the cores has
four cells for each; up to ``2 ** most_bits`` cells it is broadcast.  Beyond, with
eight, it stays in its shards: the texts are stored as chunks, a chunk sends its
cores' cells to the shards and gets back those that are hit again, and what the
third step compares is cut out of the chunks at its places.  So the texts are read
and named equally often at every size.

Edge cases: a null text is empty; texts shorter than L lose nothing; matches do
not cross texts; rows equal in id and text are different occurrences, so both
lose what repeats; null ids are like others; texts of any length are read whole;
extra columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, byte_values, checkpointed, sha, stored
from .sketch import Sketch, bits_for, build, by_chunk, chunked, fits, found_in_chunks, repeated_cells
from .spans import finish, joined_runs, row_key
from .windows import _pair, byte_symbols, sliding_least, window_names

_PLACE_BITS = 20
_BUFFER = 1 << 17


def buffers(texts: list[bytes | None], length: int) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts of at least ``length`` bytes laid side by side in buffers, long ones in pieces that share ``length - 1`` bytes.

    Each buffer comes with the pieces' starts in it, their texts' numbers and
    their offsets in these texts.
    """
    held: list[bytes] = []
    about: list[tuple[int, int, int]] = []
    size = 0

    def packed():
        starts, numbers, offsets = (np.array(x, np.int64) for x in zip(*about))
        return b"".join(held), starts, numbers, offsets

    for number, data in enumerate(texts):
        if not data or len(data) < length:
            continue
        for at in range(0, len(data) - length + 1, _BUFFER):
            piece = data[at : at + _BUFFER + length - 1]
            if held and size + len(piece) > _BUFFER + length:
                yield packed()
                held, about, size = [], [], 0
            held.append(piece)
            about.append((size, number, at))
            size += len(piece)
    if held:
        yield packed()


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of consecutive ranges, and the numbers of their ranges."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    return np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + starts[owner], owner


def anchors(data: bytes, starts: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """The runs of positions that share an anchor: core names, anchors, first and last positions in the buffer, pieces' numbers."""
    core = length // 2 + 1
    names = window_names(byte_symbols(data, 0), core, 0)
    # The place in the low bits makes the leftmost of equal names the least.
    keyed = (names >> np.uint64(_PLACE_BITS) << np.uint64(_PLACE_BITS)) | np.arange(len(names), dtype=np.uint64)
    least = sliding_least(keyed, length - core + 1) & np.uint64((1 << _PLACE_BITS) - 1)
    sizes = np.diff(np.append(starts, len(data))) - length + 1
    position, piece = _ranges(starts, sizes)
    place = least[position].astype(np.int64)  # of positions whose string stays within their piece
    new = np.flatnonzero((place[1:] != place[:-1]) | (piece[1:] != piece[:-1])) + 1
    first, last = np.concatenate(([0], new)), np.concatenate((new - 1, [len(place) - 1]))
    return names[place[first]], place[first], position[first], position[last], piece[first]


def _lanes(core: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of cores' names, which are the least of many and so not even."""
    return _pair(core, core, 0), _pair(core, core, 1)


def _spanned(data: bytes, anchor: np.ndarray, first: np.ndarray, last: np.ndarray, length: int) -> np.ndarray:
    """The 128-bit name of what each run spans, with its place around the anchor."""
    digest, pack = xxhash.xxh3_128_digest, struct.Struct("<I").pack
    names = [digest(data[p : q + length] + pack(d)) for p, q, d in zip(first.tolist(), last.tolist(), (anchor - first).tolist())]
    return np.frombuffer(b"".join(names), "<u8").reshape(-1, 2)


def _repeats(strings: list[bytes], groups: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """All windows of strings of at least ``length`` bytes: string numbers, places, two lanes of names, whether the name occurs again in the string's group, and whether it is its first there."""
    sizes = np.fromiter(map(len, strings), np.int64, len(strings))
    data = b"".join(strings)
    at, number = _ranges(np.cumsum(sizes) - sizes, sizes - length + 1)
    a, b = (window_names(byte_symbols(data, lane), length, lane)[at] for lane in (0, 1))
    group = groups[number]
    order = np.lexsort((b, a, group))
    same = (a[order][1:] == a[order][:-1]) & (b[order][1:] == b[order][:-1]) & (group[order][1:] == group[order][:-1])
    again, first = np.zeros(len(a), bool), np.ones(len(a), bool)
    again[order[1:]] |= same
    again[order[:-1]] |= same
    first[order[1:][same]] = False
    return number, at - (np.cumsum(sizes) - sizes)[number], a, b, again, first


def what_stays(batch: pa.RecordBatch) -> list:
    """Columns of the result, from keys, ids, texts and lists of the spans' starts and ends."""
    sizes, removed, counts, digests = [], [], [], []
    for data, p1, p2 in zip(byte_values(batch.column(2)), batch.column(3), batch.column(4)):
        data, kept, starts = data or b"", data or b"", ()
        if p1.is_valid:
            starts, ends = (x.tolist() for x in joined_runs(p1.values.to_numpy(), p2.values.to_numpy()))
            kept = b"".join(data[a:b] for a, b in zip([0, *ends], [*starts, len(data)]))
        sizes.append(len(data))
        removed.append(len(data) - len(kept))
        counts.append(len(starts))
        digests.append(sha(kept))
    return [batch.column(1).to_pylist(), sizes, removed, counts, digests]


FIELDS = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]


_FOUND = "core bigint, a bigint, b bigint, key bigint, p1 int, p2 int"
_STRINGS = "core bigint, a bigint, b bigint, key bigint, p1 int, data binary"


def _table(schema: str, columns: list) -> pa.RecordBatch:
    """A batch from columns and a schema in Spark's words."""
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}
    names, types = zip(*(field.split() for field in schema.split(", ")))
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(columns, types)], names=list(names))


def _runs(batch: pa.RecordBatch, length: int):
    """Buffers of a batch's texts (``key, doc_id, text``), with the runs of positions that share an anchor."""
    for data, starts, numbers, offsets in buffers(byte_values(batch.column(2)), length):
        yield data, starts, numbers, offsets, anchors(data, starts, length)


def _survivors(batch: pa.RecordBatch, length: int, sketch: Sketch):
    """Runs whose core is estimated to repeat, with the names of what they span: buffer, cores, names, keys, first and last positions, and what these lie before their places in the texts."""
    keys = batch.column(0).to_numpy(zero_copy_only=False)
    for data, starts, numbers, offsets, (core, anchor, first, last, piece) in _runs(batch, length):
        kept = np.flatnonzero(sketch.holds(*_lanes(core)))
        if len(kept):
            piece = piece[kept]
            spanned = _spanned(data, anchor[kept], first[kept], last[kept], length)
            yield data, core[kept], spanned, keys[numbers[piece]], first[kept], last[kept], offsets[piece] - starts[piece]


def _found(batch: pa.RecordBatch, length: int, sketch: Sketch) -> Iterator[pa.RecordBatch]:
    for _, core, o, key, first, last, shift in _survivors(batch, length, sketch):
        yield _table(_FOUND, [core.view(np.int64), o[:, 0].view(np.int64), o[:, 1].view(np.int64), key, first + shift, last + shift + length])


def _spans_and_open(found: DataFrame, one: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Spans of strings that repeat whole; the least ``one`` of each different string around cores that leave something open; these cores with their numbers of strings."""
    spanned = checkpointed(found.groupBy("a", "b").agg(F.min("core").alias("core"), F.count(one).alias("n"), F.min(one).alias(one)))
    settled = found.select("a", "b", "key", "p1", "p2").join(spanned.where("n > 1").select("a", "b"), ["a", "b"]).select("key", "p1", "p2")
    open_ = spanned.groupBy("core").agg(F.count("n").alias("strings"), F.min("n").alias("least")).where("strings > 1 AND least = 1").select("core", "strings")
    return settled, spanned.join(open_, "core").select("a", "b", one), open_


def _by_broadcast(base: DataFrame, length: int, bits: int, most_bits: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Spans of strings that repeat whole, strings to compare, and open cores; sketches are broadcast."""
    context = base.sparkSession.sparkContext

    def cores(batch: pa.RecordBatch):
        for *_, found in _runs(batch, length):
            yield _lanes(found[0])

    seen = context.broadcast(build(base, cores, bits))

    def runs(batches):
        for batch in batches:
            yield from _found(batch, length, seen.value)

    settled, wanted, open_ = _spans_and_open(base.mapInArrow(runs, _FOUND), "key")

    def wanted_lanes(batch: pa.RecordBatch):
        a, b, key = (c.to_numpy(zero_copy_only=False).view(np.uint64) for c in batch.columns)
        yield _pair(a, key, 0), _pair(b, key, 1)

    asked = context.broadcast(build(wanted, wanted_lanes, bits_for(max(1, wanted.count()), most_bits, 8), least=1))

    def strings(batches):
        for batch in batches:
            for data, core, o, key, first, last, shift in _survivors(batch, length, seen.value):
                own = key.astype(np.int64).view(np.uint64)
                a, b = np.ascontiguousarray(o[:, 0]), np.ascontiguousarray(o[:, 1])
                at = np.flatnonzero(asked.value.holds(_pair(a, own, 0), _pair(b, own, 1)))
                if len(at):
                    at = at[np.unique(np.stack((a[at], b[at], own[at]), axis=1), axis=0, return_index=True)[1]]
                    texts = [data[p : q + length] for p, q in zip(first[at].tolist(), last[at].tolist())]
                    yield _table(_STRINGS, [core[at].view(np.int64), a[at].view(np.int64), b[at].view(np.int64), key[at], (first + shift)[at], texts])

    return settled, base.mapInArrow(strings, _STRINGS), open_


def _by_chunks(base: DataFrame, length: int, bits: int, chunk_bytes: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The same with a sketch that stays in its shards; what survives is stored once, and strings are cut out where they lie."""
    chunks = stored(chunked(base.where(F.octet_length("text") >= length), chunk_bytes))

    def lanes(data):
        found = [_lanes(runs[0]) for batch in pa.ipc.open_stream(data) for *_, runs in _runs(batch, length)]
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.uint64),) * 2

    def find(data, sketch):
        for batch in pa.ipc.open_stream(data):
            yield from _found(batch, length, sketch)

    found = found_in_chunks(chunks, repeated_cells(chunks, lanes, bits), bits, find, _FOUND, own=True)
    found = stored(found.withColumn("row", F.monotonically_increasing_id()))
    settled, wanted, open_ = _spans_and_open(found, "row")
    places = found.join(wanted.select("row"), "row", "left_semi").select("chunk", "core", "a", "b", "key", "p1", "p2", F.lit(None).cast("binary").alias("data"))
    texts = chunks.select("chunk", *[F.lit(None).cast(t).alias(n) for n, t in places.dtypes[1:-1]], "data")
    rows = by_chunk(places.union(texts), chunks, "data")  # a null comes before the texts

    def strings(batches):
        asked: list[pa.RecordBatch] = []
        for batch in batches:
            ends = np.flatnonzero(np.asarray(batch.column(7).is_valid())).tolist()
            start = 0
            for end in ends:
                asked.append(batch.slice(start, end - start))
                start = end + 1
                of = {}
                for part in pa.ipc.open_stream(batch.column(7)[end].as_buffer()) if any(x.num_rows for x in asked) else ():
                    of |= zip(part.column(0).to_pylist(), byte_values(part.column(2)))
                for part in (x.slice(i, 5_000) for x in asked for i in range(0, x.num_rows, 5_000)):
                    core, a, b, key, p1, p2 = (part.column(i) for i in range(1, 7))
                    cut = [of[k][p:q] for k, p, q in zip(key.to_pylist(), p1.to_pylist(), p2.to_pylist())]
                    yield _table(_STRINGS, [core, a, b, key, p1, cut])
                asked.clear()
            if start < batch.num_rows:
                asked.append(batch.slice(start))

    return settled, rows.mapInArrow(strings, _STRINGS), open_


def _compared(strings: DataFrame, open_: DataFrame, length: int, group: int) -> DataFrame:
    """Spans of the windows that repeat among the strings around each core."""
    crowded = open_.where(F.col("strings") > group)
    payload = strings.join(crowded, "core", "left")
    parts = F.coalesce(F.ceil(F.col("strings") / group), F.lit(1))
    payload = payload.select("core", F.pmod(F.col("a"), parts).cast("int").alias("part"), (parts > 1).alias("crowded"), "a", "b", "key", "p1", "data")
    payload = payload.repartition("core", "part").sortWithinPartitions("core", "part", "a", "b")
    schema = pa.schema([("key", pa.int64()), ("p1", pa.int32()), ("p2", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("settled", pa.bool_())])

    def compare(batches):
        held: list[tuple] = []  # rows of whole groups, and of the one at hand

        def close():
            groups = np.cumsum([0] + [x[:2] != y[:2] for x, y in zip(held[1:], held)])
            number, place, a, b, again, lead = _repeats([r[7] for r in held], groups, length)
            key = np.array([r[5] for r in held], np.int64)
            start = np.array([r[6] for r in held], np.int64)
            changes = np.flatnonzero(number[1:] != number[:-1])
            before, after = np.concatenate(([False], again[:-1])), np.concatenate((again[1:], [False]))
            before[changes + 1] = False
            after[changes] = False
            heads, tails = np.flatnonzero(again & ~before), np.flatnonzero(again & ~after)
            none = pa.nulls(len(heads), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(key[number[heads]]), pa.array((start[number] + place)[heads], pa.int32()), pa.array((start[number] + place)[tails] + length, pa.int32()), none, none, pa.array(np.ones(len(heads), bool))], schema=schema)
            shared = np.array([r[2] for r in held])[number]  # other groups have strings around this core too
            one = np.flatnonzero(lead & shared)
            if len(one):
                own = (start[number] + place)[one]
                yield pa.RecordBatch.from_arrays([pa.array(key[number[one]]), pa.array(own, pa.int32()), pa.array(own + length, pa.int32()), pa.array(a[one].view(np.int64)), pa.array(b[one].view(np.int64)), pa.array(again[one])], schema=schema)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and held[-1][:5] == row[:5]:
                    continue
                if len(held) >= 1000 and held[-1][:2] != row[:2]:
                    yield from close()
                    held = []
                held.append(row)
        if held:
            yield from close()

    compared = checkpointed(payload.mapInArrow(compare, "key bigint, p1 int, p2 int, a bigint, b bigint, settled boolean"))
    across = compared.where("a IS NOT NULL")
    twice = across.groupBy("a", "b").agg(F.count("key").alias("n")).where("n > 1").select("a", "b")
    late = across.where("NOT settled").join(twice, ["a", "b"]).select("key", "p1", "p2")
    return compared.where("a IS NULL").select("key", "p1", "p2").union(late)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, most_bits: int = 29, group: int = 1024, chunk_bytes: int = 8 << 20) -> DataFrame:
    """What stays of each text: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``.

    ``most_bits`` bounds the sketches that are broadcast; where they need more, they
    stay in their shards, which ``chunk_bytes`` of text ask at once.  ``group`` is
    the different strings around a core that one group takes.
    """
    bounded_batches(docs.sparkSession)
    text = F.col(f"`{text_col}`").cast("string")
    base = docs.select(row_key(docs, id_col, text_col).alias("key"), F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), text.alias("text"))
    size = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    about = 2 * size // max(1, length // 2)  # runs of positions that share an anchor
    if fits(about, most_bits):
        settled, strings, open_ = _by_broadcast(base, length, bits_for(about, most_bits), most_bits)
    else:
        settled, strings, open_ = _by_chunks(base, length, bits_for(about, 48, 8), chunk_bytes)
    spans = settled.union(_compared(strings, open_, length, group))
    return finish(base, spans, FIELDS, what_stays)
