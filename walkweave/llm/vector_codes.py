"""Vector code compression: product codes of whole-number vectors by weighted Lloyd rounds over distinct parts.

Components become floor(scale * x), and a vector is cut into equal consecutive
parts.  Equal parts of one position are one row with a weight, so that copies
cost nothing however many they are; each round assigns the distinct parts to
their codebook's nearest entries in the tasks and adds up weighted sums in Spark,
and the driver holds the codebooks only (parts x entries x components).  At last
the distinct parts' codes and errors are joined back to the vectors.

A part that a two-thousandth of all rows or more have, of which there are few by
that bound, is joined by broadcast, all others by their values; so no group of
copies lands in one task.  Whole numbers are exact at any size; an error beyond
64 bits counts as the largest long.

Edge cases: vectors that are null, or hold null or non-finite components, are
left out; of a vector whose length is not that of the first one (by id) the code
and the error are null; a length that the parts don't divide counts as filled up
with zeros; with fewer vectors than entries the codebooks are as much smaller;
repeated rows are rows of their own; null ids come last, and of equal ids the
smaller vector first; null labels are equal; extra columns are ignored; an empty
table gives an empty one.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, byte_values, checkpointed, stored
from .topk import takes_part

#: A part is hot if a row in so many has it.
HOT = 2_000
_MOST = (1 << 63) - 1


def grid(x: Column, scale: int) -> Column:
    """floor(scale * x) / scale as a double, which is exact: beyond 2^52 / scale all doubles are on the grid."""
    return F.when(F.abs(x) < F.lit(2.0**52 / scale), F.floor(x * scale) / F.lit(float(scale))).otherwise(x)


def whole(y: np.ndarray, scale: int) -> np.ndarray:
    """Values on the grid times ``scale``: doubles where all are small, else Python's whole numbers."""
    if float(np.abs(y).max(initial=0)) < 2**30 / scale:
        return y * scale
    return np.array([int(v * scale) if abs(v) < 2**41 else int(v) * scale for v in y.ravel().tolist()], object).reshape(y.shape)


def pack(rows: np.ndarray) -> list[bytes]:
    """Whole-number rows as bytes, the same for equal rows: two bytes a component where that is enough, else text."""
    if not rows.shape[1]:
        return [b""] * len(rows)
    small = np.array([-32768 <= min(r) and max(r) <= 32767 for r in rows.tolist()], bool) if rows.dtype == object else (rows.min(axis=1) >= -32768) & (rows.max(axis=1) <= 32767)
    data = np.where(small[:, None], rows, 0).astype("<i2").tobytes()
    size = 2 * rows.shape[1]
    packed = [data[i : i + size] for i in range(0, len(data), size)]
    for i in np.flatnonzero(~small).tolist():
        # The mark in front keeps texts apart from packed rows, which have an even number of bytes.
        text = ",".join(str(int(v)) for v in rows[i].tolist()).encode()
        packed[i] = b"+" + text + b" " * (len(text) % 2)
    return packed


def unpack(packed: list[bytes], size: int) -> np.ndarray:
    """The rows: doubles where that is exact, else Python's whole numbers."""
    if not size:
        return np.zeros((len(packed), 0))
    long = [i for i, p in enumerate(packed) if len(p) % 2]
    if not long:
        return np.frombuffer(b"".join(packed), "<i2").reshape(-1, size).astype(np.float64)
    rows = [[int(v) for v in p[1:].split(b",")] if len(p) % 2 else np.frombuffer(p, "<i2").tolist() for p in packed]
    return np.array([v for r in rows for v in r], object).reshape(-1, size)


def nearest(rows: np.ndarray, book: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """For each row the nearest entry (the lowest of equals) and the squared distance, exactly."""
    most = max((abs(v) for entry in book for v in entry), default=0)
    if rows.dtype != object:
        most = max(most, int(np.abs(rows).max(initial=0)))
        if (2 * most) ** 2 * max(1, rows.shape[1]) < 2**52:
            c = np.array(book, np.float64).reshape(len(book), rows.shape[1])
            away = (rows * rows).sum(axis=1)[:, None] - 2 * (rows @ c.T) + (c * c).sum(axis=1)
            at = away.argmin(axis=1)
            return at, away[np.arange(len(rows)), at].astype(np.int64)
    at, errors = [], []
    for row in rows.tolist():
        row = list(map(int, row))
        error, entry = min((sum((a - b) ** 2 for a, b in zip(row, c)), e) for e, c in enumerate(book))
        at.append(entry)
        errors.append(error)
    return np.array(at, np.int64), np.array(errors, object)


def _rows(vectors: DataFrame, id_col: str, vector_col: str, label_col: str | None, scale: int) -> DataFrame:
    """The kept vectors as ``id, label, y, row``, stored, so that the numbers of rows hold."""
    vector = F.col(f"`{vector_col}`").cast("array<double>")
    label = F.col(f"`{label_col}`") if label_col else F.lit(None).cast("int")
    kept = vectors.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), label.alias("label"), vector.alias("v")).where(takes_part(F.col("v")))
    return stored(kept.select("id", "label", F.transform("v", lambda x: grid(x, scale)).alias("y"), F.monotonically_increasing_id().alias("row")))


def _parts(rows: DataFrame, dim: int, parts: int, scale: int) -> DataFrame:
    """``row, id, label, pos, part`` of vectors with ``dim`` components: a row for each part, packed."""
    size = math.ceil(dim / parts)
    bounded_batches(rows.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            flat = whole(batch.column(3).flatten().to_numpy(zero_copy_only=False).reshape(n, dim), scale)
            filled = np.zeros((n, size * parts), flat.dtype)
            filled[:, :dim] = flat
            packed = pack(filled.reshape(n * parts, size))
            each = pa.array(np.repeat(np.arange(n), parts))
            held = [batch.column(c).take(each) for c in range(3)]
            yield pa.RecordBatch.from_arrays([*held, pa.array(np.tile(np.arange(parts, dtype=np.int32), n)), pa.array(packed, pa.binary())], names=["row", "id", "label", "pos", "part"])

    kind = rows.schema["label"].dataType.simpleString()
    return rows.where(F.size("y") == dim).select("row", "id", "label", "y").mapInArrow(cut, f"row bigint, id bigint, label {kind}, pos int, part binary")


class Codebooks:
    """Entries by part; ``vector`` decodes."""

    def __init__(self, books: list[list[list[int]]], dim: int, scale: int):
        self.books, self.dim, self.scale = books, dim, scale

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(v) for book in self.books for entry in book for v in entry).encode()).hexdigest()

    def vector(self, code: str) -> list[float]:
        """The vector that a code stands for."""
        picked = [v for part, book in enumerate(self.books) for v in book[int(code[2 * part : 2 * part + 2], 16)]]
        return [v / self.scale for v in picked[: self.dim]]


def _first(rows: DataFrame, n: int) -> list[list[float]]:
    return [r.y for r in rows.orderBy(F.asc_nulls_last("id"), "y").limit(n).select("y").collect()]


def _start(rows: DataFrame, parts: int, entries: int, scale: int) -> Codebooks | None:
    """The first codebooks: the parts of the first vectors by id."""
    first = _first(rows, 1)
    if not first:
        return None
    dim = len(first[0])
    size = math.ceil(dim / parts)
    exact = [[int(v) for v in whole(np.array(y), scale).tolist()] + [0] * (size * parts - dim) for y in _first(rows.where(F.size("y") == dim), entries)]
    return Codebooks([[v[p * size : (p + 1) * size] for v in exact] for p in range(parts)], dim, scale)


def _by_position(batch: pa.RecordBatch, books: list[list[list[int]]]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each position in a batch: it, the places of its rows, the rows, their entries and their distances."""
    pos, packed = batch.column(0).to_numpy(), byte_values(batch.column(1))
    for p in np.unique(pos).tolist():
        at = np.flatnonzero(pos == p)
        rows = unpack([packed[i] for i in at.tolist()], len(books[p][0]))
        yield p, at, rows, *nearest(rows, books[p])


def _round(distinct: DataFrame, held: Codebooks) -> Codebooks:
    """The codebooks after one weighted Lloyd round."""
    books = held.books

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], list[int]] = {}
        for batch in batches:
            weights = batch.column(2).to_numpy()
            for p, at, rows, entries, _ in _by_position(batch, books):
                n = weights[at]
                most = int(np.abs(rows).max(initial=1)) if rows.dtype != object else 1 << 62
                exact = most * sum(n.tolist()) < 2**52
                for e in np.unique(entries).tolist():
                    here = entries == e
                    own, of = n[here], rows[here]
                    made = (own.astype(np.float64) @ of).tolist() if exact else [sum(int(v) * w for v, w in zip(column, own.tolist())) for column in of.T.tolist()]
                    total = found.setdefault((p, e), [0] * (1 + rows.shape[1]))
                    for i, v in enumerate([sum(own.tolist()), *made]):
                        total[i] += int(v)
        out = []
        for (p, e), values in found.items():
            for i, value in enumerate(values):
                # A sum goes in digits of 2^31, so that sums of many tasks' digits are longs.
                sign, left, digit = (-1 if value < 0 else 1), abs(value), 0
                while left:
                    out.append((p, e, i, digit, sign * (left & 0x7FFFFFFF)))
                    left, digit = left >> 31, digit + 1
        columns = list(zip(*out)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()) for c in columns[:4]] + [pa.array(columns[4], pa.int64())], names=["pos", "entry", "at", "digit", "v"])

    tasks = distinct.select("pos", "part", "n").mapInArrow(sums, "pos int, entry int, at int, digit int, v bigint")
    total: dict[tuple[int, int], dict[int, int]] = {}
    # As many rows as there are entries' components and digits.
    for r in tasks.groupBy("pos", "entry", "at", "digit").agg(F.sum("v").alias("v")).collect():
        one = total.setdefault((r.pos, r.entry), {})
        one[r["at"]] = one.get(r["at"], 0) + (r.v << (31 * r.digit))
    return Codebooks(
        [[[total[p, e].get(i + 1, 0) // total[p, e][0] for i in range(len(entry))] if (p, e) in total else entry for e, entry in enumerate(book)] for p, book in enumerate(books)],
        held.dim,
        held.scale,
    )


def _assigned(distinct: DataFrame, held: Codebooks) -> DataFrame:
    """``pos, part, n, entry, error`` of the distinct parts."""
    books = held.books

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            entry, error = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows, np.int64)
            for _, at, _, entries, away in _by_position(batch, books):
                entry[at] = entries
                error[at] = np.array([min(_MOST, v) for v in away.tolist()], np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(entry), pa.array(error)], names=["pos", "part", "n", "entry", "error"])

    return distinct.select("pos", "part", "n").mapInArrow(assign, "pos int, part binary, n bigint, entry int, error bigint")


def _looked_up(rows: DataFrame, values: DataFrame, keys: list[str], hot: Column) -> DataFrame:
    """Rows with the values of their keys: hot keys', at most a few thousand, by broadcast, all others' by a join."""
    names = [c for c in values.columns if c not in keys]

    def join(side: DataFrame, held: DataFrame, how: str) -> DataFrame:
        there = held.select(*(F.col(k).alias(f"__{k}") for k in keys), *names, F.lit(True).alias("__there"))
        on = [side[k].eqNullSafe(there[f"__{k}"]) for k in keys]
        return side.join(there, on, how).drop(*(f"__{k}" for k in keys))

    some = join(rows, F.broadcast(values.where(hot)), "left")
    rest = join(some.where("__there IS NULL").select(rows.columns), values.where(~hot), "inner")
    return some.where("__there").drop("__there").unionByName(rest.drop("__there"))


def _capped(total: Column) -> Column:
    return F.when(total.isNotNull(), F.least(total, F.lit(_MOST).cast("decimal(38,0)"))).cast("bigint")


def fit(rows: DataFrame, distinct: DataFrame, parts: int, entries: int, rounds: int, scale: int) -> Codebooks | None:
    held = _start(rows, parts, entries, scale)
    for _ in range(rounds if held else 0):
        held = _round(distinct, held)
    return held


def compress(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label", parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096
) -> tuple[DataFrame, Codebooks | None]:
    """Each kept row's ``vec_id, code, error, label_error, codebooks_sha256``, and the codebooks (none for an empty table)."""
    if scale & (scale - 1) or not 0 < entries <= 256:
        raise ValueError("the scale must be a power of two, and an entry's index must go into two digits")
    spark = vectors.sparkSession
    rows = _rows(vectors, id_col, vector_col, label_col, scale)
    first = _first(rows, 1)
    if not first:
        return spark.createDataFrame([], "vec_id bigint, code string, error bigint, label_error bigint, codebooks_sha256 string"), None
    cut = _parts(rows, len(first[0]), parts, scale)
    distinct = stored(cut.groupBy("pos", "part").agg(F.count(F.lit(1)).alias("n")))
    held = fit(rows, distinct, parts, entries, rounds, scale)
    hot = math.ceil(rows.count() / HOT)
    coded = stored(_assigned(distinct, held))
    joined = _looked_up(cut, coded, ["pos", "part"], F.col("n") >= max(2, hot))
    digits = [F.lpad(F.hex(F.max(F.when(F.col("pos") == p, F.col("entry"))).cast("bigint")), 2, "0") for p in range(parts)]
    error = _capped(F.sum(F.col("error").cast("decimal(38,0)")))
    made = joined.groupBy("row", "id", "label").agg(F.lower(F.concat(*digits)).alias("code"), error.alias("error")).drop("row")
    others = rows.where(F.size("y") != held.dim).select("id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("bigint").alias("error"))
    made = stored(made.unionByName(others))
    of_label = checkpointed(made.groupBy("label").agg(_capped(F.sum(F.col("error").cast("decimal(38,0)"))).alias("label_error"), F.count(F.lit(1)).alias("n")))
    out = _looked_up(made, of_label, ["label"], F.col("n") >= max(2, hot))
    return out.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(held.sha256()).alias("codebooks_sha256")), held


def decode(codes: DataFrame, held: Codebooks, code_col: str = "code") -> DataFrame:
    """The rows with ``decoded``, the vector that a code stands for (null for a null code), with built-in functions."""
    books = F.lit([[[v / held.scale for v in entry] for entry in book] for book in held.books])
    parts = range(len(held.books))
    index = [F.conv(F.substring(F.col(f"`{code_col}`"), 2 * p + 1, 2), 16, 10).cast("int") for p in parts]
    return codes.withColumn("decoded", F.when(F.col(f"`{code_col}`").isNotNull(), F.slice(F.flatten(F.array(*(books[p][index[p]] for p in parts))), 1, held.dim)))


def _sql(rounds: int = 6) -> str:
    """The same in DuckDB's SQL; each round is two subqueries."""
    away = "list_sum(list_transform(range(1, len(part) + 1), lambda i: (part[i] - c[i]) * (part[i] - c[i])))"
    steps = [
        """
v AS MATERIALIZED (
  SELECT row_number() OVER () AS k, vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT k, vec_id, pos, list_slice(q, pos * (len(q) // 8) + 1, (pos + 1) * (len(q) // 8)) AS part FROM v, range(8) t(pos)),
d AS MATERIALIZED (SELECT pos, part, count(*) AS n FROM p GROUP BY pos, part),
c0 AS MATERIALIZED (
  SELECT pos, row_number() OVER (PARTITION BY pos ORDER BY vec_id) - 1 AS e, part AS c FROM p JOIN (SELECT k FROM v ORDER BY vec_id LIMIT 16) USING (k))"""
    ]
    for i in range(rounds + 1):
        steps.append(f"a{i} AS MATERIALIZED (SELECT pos, part, n, min(struct_pack(away := {away}, e := e)) AS b FROM d JOIN c{i} USING (pos) GROUP BY pos, part, n)")
        if i < rounds:
            steps.append(
                f"""c{i + 1} AS MATERIALIZED (
  SELECT pos, e, coalesce(new, c) AS c FROM c{i} LEFT JOIN (
    SELECT pos, e, list(CAST((s - ((s % w) + w) % w) // w AS BIGINT) ORDER BY i) AS new FROM (
      SELECT pos, b.e AS e, i, sum(n * part[i]) AS s, sum(n) AS w FROM (SELECT pos, part, n, b, unnest(range(1, len(part) + 1)) AS i FROM a{i}) GROUP BY ALL)
    GROUP BY pos, e) USING (pos, e))"""
            )
    return f"""
WITH {", ".join(steps)},
sha AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY pos, e)) AS codebooks_sha256 FROM c{rounds}),
r AS (
  SELECT k, string_agg(lpad(format('{{:x}}', b.e), 2, '0'), '' ORDER BY pos) AS code, CAST(sum(b.away) AS BIGINT) AS error
  FROM p JOIN a{rounds} USING (pos, part) GROUP BY k)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM v JOIN r USING (k), sha
"""


SQL = _sql()
