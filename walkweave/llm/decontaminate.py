"""Benchmark decontamination: one Aho-Corasick automaton over normalised items, run once over each text.

Texts and items are lower-cased (A-Z only) and cut into words of digits, letters
and all characters beyond ASCII.  An item's windows are its runs of ``width``
words (the whole item if it has fewer).  The automaton's symbols are words, so
that its matches are word ranges, which map back to offsets in the original
text.  A word inside any matching window is hit.

The automaton is broadcast, so the items' size is checked: their texts may have
``block_bytes`` bytes together (the automaton takes some hundred bytes for each).
A larger benchmark stays distributed: its windows are named by 128-bit hashes, one
scan of the texts names theirs and keeps those that a sketch of the benchmark's
knows, and these are joined.  Both ways give the same rows.

Edge cases: a null text or item has no words; a null ``item_id`` still marks
words but is no item in counts and digests; equal ids count once; repeated
documents give repeated rows; extra columns are ignored; with an empty benchmark
nothing is hit.
"""

from __future__ import annotations

import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, byte_values, keep_rows, map_rows, sha, stored, texts
from .sketch import bits_for, of_column
from .spans import finish, row_key
from .windows import window_names, word_symbols

#: A-Z become lower case; other ASCII characters but digits and letters become spaces.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = re.compile(rb"[^ ]+")


def words(data: bytes | None) -> list[bytes]:
    return data.translate(_FOLD).split() if data else []


class Items:
    """The automaton over the windows of some items."""

    def __init__(self, items: list[tuple[int | None, bytes | None]], width: int = 10):
        self.codes: dict[bytes, int] = {}
        windows: dict[tuple[int, ...], set] = {}
        for item, data in items:
            sequence = [self.codes.setdefault(w, len(self.codes) + 1) for w in words(data)]
            for i in range(max(1, len(sequence) - width + 1) if sequence else 0):
                windows.setdefault(tuple(sequence[i : i + width]), set()).add(item)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for window, owners in windows.items():
            self.automaton.add_word(window, (len(window), owners))
        if windows:
            self.automaton.make_automaton()
        self.empty = not windows

    def find(self, sequence: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Ranges of hit words, joined and in order, and the ids of the items with matching windows."""
        if self.empty or not sequence:
            return [], set()
        code = self.codes.get
        ranges: list[tuple[int, int]] = []
        owners: set = set()
        for end, (n, items) in self.automaton.iter(tuple([code(w, 0) for w in sequence])):
            ranges.append((end - n + 1, end + 1))
            owners |= items
        return joined(ranges), owners


def joined(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The ranges in order, those that touch or overlap as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def offsets(data: bytes, ranges: list[tuple[int, int]]) -> list[int]:
    """Starts and ends, in code points of the original text, of ranges of its words."""
    if not ranges:
        return []
    places = [m.span() for m in _WORD.finditer(data.translate(_FOLD))]
    return [len(data[:at].decode()) for a, b in ranges for at in (places[a][0], places[b - 1][1])]


def _automaton(items: DataFrame, item_col: str, text_col: str, block_bytes: int) -> list[tuple[int | None, bytes | None]] | None:
    """All items, if their texts have at most ``block_bytes`` bytes together; else None."""
    own = items.select(F.col(f"`{item_col}`").cast("bigint").alias("item"), F.col(f"`{text_col}`").cast("string").alias("text"))
    own = own.where("text IS NOT NULL").distinct()
    # An item counts for itself, too, as empty texts have no bytes.
    total = own.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    return [(r[0], r[1].encode()) for r in own.collect()] if total <= block_bytes else None


def _windows(items: DataFrame, item_col: str, text_col: str, width: int) -> DataFrame:
    """``n, a, b, item``: the windows of all items by their 128-bit names."""

    def run(batches):
        for batch in batches:
            columns: list[list] = [[], [], [], []]
            for item, data in zip(batch.column(0).to_pylist(), byte_values(batch.column(1))):
                found = words(data)
                n = min(len(found), width)
                if n:
                    a, b = (window_names(x, n, lane).view(np.int64) for lane, x in enumerate(word_symbols(found)))
                    for column, values in zip(columns, ([n] * len(a), a, b, [item] * len(a))):
                        column.extend(values)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["n", "a", "b", "item"])

    own = items.select(F.col(f"`{item_col}`").cast("bigint").alias("item"), F.col(f"`{text_col}`").cast("string").alias("text"))
    bounded_batches(own.sparkSession)
    return stored(own.mapInArrow(run, "n int, a bigint, b bigint, item bigint").distinct())


def _joined_hits(base: DataFrame, windows: DataFrame) -> DataFrame:
    """``key, at, n, a, b``: where windows of items occur in the texts of ``base`` (``key, doc_id, text``).

    A sketch of the windows' names, of a size that does not grow with them
    beyond 2^29 cells, keeps most other windows from the join, which is exact.
    """
    kinds = windows.select("n", "a", "b").distinct()
    lengths = sorted(r[0] for r in kinds.select("n").distinct().collect())  # so many as a window has words
    sketch = base.sparkSession.sparkContext.broadcast(of_column(kinds, ["a", "b"], bits_for(kinds.count(), 29, 16)))
    bounded_batches(base.sparkSession)

    def run(batches):
        for batch in batches:
            out = []
            for key, data in zip(batch.column(0).to_pylist(), byte_values(batch.column(2))):
                found = words(data)
                symbols = word_symbols(found) if found else ()
                for n in lengths if found else ():
                    a, b = (window_names(x, n, lane) for lane, x in enumerate(symbols))
                    at = np.flatnonzero(sketch.value.holds(a, b))
                    if len(at):
                        out.append((np.full(len(at), key), at, np.full(len(at), n), a[at].view(np.int64), b[at].view(np.int64)))
            if out:
                columns = [np.concatenate(x) for x in zip(*out)]
                types = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["key", "at", "n", "a", "b"])

    return stored(base.mapInArrow(run, "key bigint, at int, n int, a bigint, b bigint").join(kinds, ["n", "a", "b"]).select("key", "at", "n", "a", "b"))


def _counts(data: list[bytes | None], sequences: list[list[bytes]], hits: list[list[tuple[int, int]]]) -> list[list]:
    """Words, hit words, and the hits' offsets in the original texts."""
    return [[len(x) for x in sequences], [sum(b - a for a, b in x) for x in hits], [offsets(d or b"", x) for d, x in zip(data, hits)]]


RESULT = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans")


def find_contamination(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = 10, block_bytes: int = 4 << 20
) -> DataFrame:
    """Each document's hits: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans``.

    ``spans``: starts and ends, one after another, of the hit ranges in code
    points of the original text.  ``block_bytes`` bounds the automaton.
    """
    block = _automaton(items, item_col, item_text_col, block_bytes)
    if block is None:
        return _find_by_join(docs, _windows(items, item_col, item_text_col, width), id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(block)

    def make():
        found_by = Items(shared.value, width)

        def step(batch: pa.RecordBatch):
            data = byte_values(batch.column(1))
            sequences = [words(x) for x in data]
            found = [found_by.find(x) for x in sequences]
            counts, n_hit, spans = _counts(data, sequences, [x for x, _ in found])
            owners = [sorted(str(i) for i in x if i is not None) for _, x in found]
            yield [batch.column(0).to_pylist(), counts, n_hit, [len(x) for x in owners], [sha(",".join(x).encode()) for x in owners], [n > 0 for n in n_hit], spans]

        return step

    types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.int32()))
    return map_rows(texts(docs, id_col, text_col), list(zip(RESULT, types)), make)


def _find_by_join(docs: DataFrame, windows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    base = _keyed(docs, id_col, text_col)
    hits = _joined_hits(base, windows)
    own = hits.select("key", "n", "a", "b").distinct().join(windows.where("item IS NOT NULL"), ["n", "a", "b"]).select("key", "item").distinct()
    listed = F.array_sort(F.collect_list(F.col("item").cast("string")))
    owners = own.groupBy(F.col("key").alias("owned")).agg(F.count("item").alias("n_items"), F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"))

    def step(batch: pa.RecordBatch):
        data = byte_values(batch.column(2))
        ranges = [joined(list(zip(p.as_py(), q.as_py()))) if p.is_valid else [] for p, q in zip(batch.column(3), batch.column(4))]
        return [batch.column(0).to_pylist(), batch.column(1).to_pylist(), *_counts(data, [words(x) for x in data], ranges)]

    fields = [("key", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("spans", pa.list_(pa.int32()))]
    found = finish(base, hits.select("key", F.col("at").alias("p1"), (F.col("at") + F.col("n")).alias("p2")), fields, step)
    rows = found.join(owners, F.col("key") == F.col("owned"), "left")
    return rows.withColumns({"n_items": F.coalesce("n_items", F.lit(0).cast("bigint")), "items_sha256": F.coalesce("items_sha256", F.lit(sha(b""))), "contaminated": F.col("n_hit") > 0}).select(*RESULT)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``key, doc_id, text`` under fixed names."""
    return docs.select(row_key(docs, id_col, text_col).alias("key"), F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def drop_contaminated(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = 10, block_bytes: int = 4 << 20
) -> DataFrame:
    """The documents without any hit word, with all their columns."""
    block = _automaton(items, item_col, item_text_col, block_bytes)
    if block is None:
        hit = _joined_hits(_keyed(docs, id_col, text_col), _windows(items, item_col, item_text_col, width)).select(F.col("key").alias("__hit")).distinct()
        return docs.withColumn("__key", row_key(docs, id_col, text_col)).join(hit, F.col("__key") == F.col("__hit"), "left_anti").drop("__key")
    place, shared = docs.columns.index(text_col), docs.sparkSession.sparkContext.broadcast(block)

    def make():
        found_by = Items(shared.value, width)
        return lambda batch: [not found_by.find(words(x))[0] for x in byte_values(batch.column(place))]

    return keep_rows(docs, make)


#: The same counts in DuckDB's SQL.
SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(list_slice(w, i, i + 9), ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
m AS (
  SELECT d.k, i, p.item_id, p.n FROM (SELECT DISTINCT n FROM p) s, LATERAL (SELECT k, w, unnest(range(1, len(w) - s.n + 2)) AS i, s.n AS n FROM d WHERE len(w) >= s.n) d
  JOIN p ON p.n = d.n AND p.win = array_to_string(list_slice(d.w, d.i, d.i + d.n - 1), ' ')),
h AS (SELECT k, count(DISTINCT j) AS n_hit FROM (SELECT k, unnest(range(i, i + n)) AS j FROM m) GROUP BY k),
o AS (SELECT k, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM m GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (k) LEFT JOIN o USING (k)
"""
