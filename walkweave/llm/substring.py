"""Substring dedup of word windows: a count-min prefilter, then exact groups of what it lets through.

A first pass counts the windows of all documents in a sketch (merged from the
tasks' sketches), whose counts are never too low.  A second pass groups, by
their 128-bit names, only the windows that the sketch has at least twice; a
window counts once a document.  Whole copies of a text are found first and take
no part: all their windows start in the smallest document of the copies.

A sketch has about four cells in each of two rows for every window, so that about
one unique window in twenty gets through.  Where that is more than
``2 ** most_bits`` cells, the sketch, then with eight cells, is not broadcast:
the texts are stored as chunks, each chunk's cells go to the sketch's shards, and
the shards send back which of them are hit again.  So the texts are read and
hashed equally often at every size, and no task, nor the driver, holds the sketch.

Names of windows, and of whole copies, are 128-bit hashes.  Of n different ones
two are alike with a chance of n * n / 2 ** 129: 4e-13 for the windows of 100 TB.

Edge cases: a null text has no words; a null id neither removes nor loses
words; rows that share an id don't remove each other's words; texts of any
length count whole; repeated rows give repeated rows; extra columns are ignored;
an empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, byte_values, checkpointed, sha, stored
from .sketch import bits_for, build, chunked, fits, found_in_chunks, of_column, repeated_cells
from .spans import finish, has_repeated_ids, joined_runs, row_key
from .windows import window_names, word_symbols


def _names(words: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    a, b = word_symbols(words)
    return window_names(a, width, 0), window_names(b, width, 1)


def _first_places(a: np.ndarray) -> np.ndarray:
    """Places of the first occurrences of a lane's values."""
    return np.unique(a, return_index=True)[1]


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 13, most_bits: int = 30, broadcast_rows: int = 2_000_000, chunk_bytes: int = 8 << 20) -> DataFrame:
    """What stays of each document: ``doc_id, n_words, n_removed, kept_sha256``.

    ``most_bits`` bounds a sketch that is broadcast (two rows of ``2 ** most_bits``
    bits), and larger ones stay in their shards, where ``chunk_bytes`` of text ask
    them at once; ``broadcast_rows`` bounds the list of whole copies that is
    broadcast instead of joined by a shuffle.
    """
    text = F.col(f"`{text_col}`").cast("string")
    keyed = has_repeated_ids(docs, id_col)  # else the id is the key
    key = row_key(docs, id_col, text_col, keyed)
    base = docs.select(key.alias("key"), F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), text.alias("text"))
    base = base.withColumn("key", F.when(F.col("doc_id").isNotNull(), F.col("key")))
    prints = checkpointed(base.where("key IS NOT NULL AND text IS NOT NULL").select("key", "doc_id", F.unhex(F.md5("text")).alias("m"), F.octet_length("text").alias("bytes")))
    # Stored apart, so that Spark can split the join's share of a text with very many copies.
    firsts = checkpointed(prints.groupBy("m").agg(F.min("doc_id").alias("first"), F.count("doc_id").alias("n")).where("n > 1").drop("n"))
    copies = checkpointed(prints.join(firsts, "m").where("doc_id > first").select("key", F.lit(True).alias("copy")).distinct())
    size = prints.agg(F.sum("bytes")).first()
    if copies.limit(broadcast_rows + 1).count() <= broadcast_rows:
        copies = F.broadcast(copies)
    marked = base.join(copies, "key", "left").select("key", "doc_id", "text", "copy")

    def sequences(batch: pa.RecordBatch):
        for i, (own, data, copy) in enumerate(zip(batch.column(0).to_pylist(), byte_values(batch.column(2)), batch.column(3).to_pylist())):
            if own is not None and data and not copy:
                words = data.split()
                if len(words) >= width:
                    yield i, words

    about = 2 * (size[0] or 0) // 11  # windows, as words and the spaces behind them have five or six bytes in most languages
    context = docs.sparkSession.sparkContext

    def hashes(batch: pa.RecordBatch):
        for _, words in sequences(batch):
            a, b = _names(words, width)
            at = _first_places(a)
            yield a[at], b[at]

    def held_by(sketch, batches, once: bool):
        """The windows that a sketch holds, as rows; with ``once``, those of a document that are alike as one, without places."""
        for batch in batches:
            keys, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            parts: list[tuple] = []

            def rows():
                a, b, at, own, key_of = (np.concatenate(x) for x in zip(*parts))
                parts.clear()
                columns = {"a": a.view(np.int64), "b": b.view(np.int64), "doc_id": own}
                return pa.RecordBatch.from_pydict(columns if once else columns | {"at": at} | ({"key": key_of} if keyed else {}))

            held = 0
            for i, words in sequences(batch):
                a, b = _names(words, width)
                at = np.flatnonzero(sketch.holds(a, b))
                if once and len(at):
                    at = at[_first_places(a[at])]
                if len(at):
                    parts.append((a[at], b[at], at.astype(np.int32), np.full(len(at), ids[i]), np.full(len(at), keys[i])))
                    held += len(at)
                if held > 200_000:
                    yield rows()
                    held = 0
            if parts:
                yield rows()

    def windows(chosen, once: bool):
        def run(batches):
            yield from held_by(chosen.value, batches, once)

        return run

    def of_chunk(data):
        found = [x for batch in pa.ipc.open_stream(data) for x in hashes(batch)]
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.uint64),) * 2

    def in_chunk(data, sketch):
        yield from held_by(sketch, pa.ipc.open_stream(data), True)

    schema = "a bigint, b bigint, doc_id bigint"
    shared = None
    if fits(about, most_bits):
        shared = context.broadcast(build(marked, hashes, bits_for(about, most_bits)))
        seen = marked.mapInArrow(windows(shared, True), schema)
    else:
        bounded_batches(docs.sparkSession)
        chunks = stored(chunked(marked.where("key IS NOT NULL AND text IS NOT NULL AND copy IS NULL"), chunk_bytes))
        bits = bits_for(about, 48, 8)
        seen = found_in_chunks(chunks, repeated_cells(chunks, of_chunk, bits), bits, in_chunk, schema)
    repeated = stored(seen.groupBy("a", "b").agg(F.min("doc_id").alias("first"), F.count("doc_id").alias("n")).where("n > 1").drop("n"))
    if shared:
        shared.destroy()  # what was computed with it is stored
    exact = context.broadcast(of_column(repeated, ["a", "b"], bits_for(repeated.count(), most_bits, 8)))
    placed = marked.mapInArrow(windows(exact, False), schema + ", at int" + ", key bigint" * keyed)
    hits = placed.join(repeated, ["a", "b"]).where("doc_id > first").select(F.col("key" if keyed else "doc_id").alias("key"), F.col("at").alias("p1"), (F.col("at") + width).alias("p2"))

    def step(batch: pa.RecordBatch):
        counts, removed, digests = [], [], []
        for data, copy, p1, p2 in zip(byte_values(batch.column(2)), batch.column(3).to_pylist(), batch.column(4), batch.column(5)):
            words = data.split() if data else []
            kept = words
            if copy:
                kept = words if len(words) < width else []
            elif p1.is_valid:
                kept, at = [], 0
                for a, b in zip(*(x.tolist() for x in joined_runs(p1.values.to_numpy(), p2.values.to_numpy()))):
                    kept += words[at:a]
                    at = b
                kept += words[at:]
            counts.append(len(words))
            removed.append(len(words) - len(kept))
            digests.append(sha(b" ".join(kept)))
        return [batch.column(1).to_pylist(), counts, removed, digests]

    fields = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())]
    return finish(marked, hits, fields, step)


#: The same in DuckDB's SQL.
SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT k, doc_id, i, array_to_string(list_slice(w, i, i + 12), ' ') AS win FROM (SELECT k, doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
f AS (SELECT win, min(doc_id) AS first FROM x GROUP BY win),
r AS (SELECT DISTINCT k, unnest(range(i, i + 13)) AS j FROM x JOIN f USING (win) WHERE doc_id > first),
u AS (SELECT k, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM d),
s AS (SELECT u.k, string_agg(word, ' ' ORDER BY u.j) AS kept, count(*) AS n FROM u ANTI JOIN r ON u.k = r.k AND u.j = r.j GROUP BY u.k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN s USING (k)
"""
