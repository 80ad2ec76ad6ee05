"""Importance resampling towards a target distribution, by an external sort-count of hashed word runs.

Every run of 1 to ``grams`` words of a text is hashed into a bucket.  One pass
writes the texts' buckets as packed streams of 16-bit numbers, in blocks with the
offset of each text; a second pass sorts each block and run-length encodes it, and
the runs are merged to counts.  The counts of both sides give each bucket's gain,
and a third pass gathers the gains along the streams and adds them up between the
offsets.  Texts are read once.

A text's weight is the floored mean of its gains, its score the weight plus
Gumbel noise that comes from its id, so that the highest scores are a sample
without replacement.  Scores are whole numbers in a range that the gains bound, so
their counts tell the lowest score drawn; only rows from it on are sorted, dealt
by range.

Edge cases: a null or empty text has no words, weight 0, and is drawn only if
``least_words`` is 0; a null id counts as the empty string for its noise and comes
after all others; repeated rows give repeated rows, each with a rank of its own;
extra columns are ignored; an empty table gives an empty one; with an empty
target all texts are weighed against equal shares.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_values, map_rows, stored, texts

#: A-Z become lower case.
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


class Hasher:
    """Buckets of word runs; those met are kept, up to ``keep`` of them."""

    def __init__(self, grams: int, buckets: int, keep: int = 500_000):
        self.grams, self.buckets, self.keep = grams, buckets, keep
        self._known: dict[bytes, int] = {}

    def __call__(self, data: bytes | None) -> tuple[int, array]:
        """The number of words, and the buckets of all runs."""
        words = _WORD.findall(data.translate(_LOWER)) if data else []
        if len(self._known) > self.keep:
            self._known.clear()
        get, new, found = self._known.get, self._new, array("H")
        for n in range(1, self.grams + 1):
            runs = words if n == 1 else map(b" ".join, zip(*(words[i:] for i in range(n))))
            found.extend([b if (b := get(run)) is not None else new(run) for run in runs])
        return len(words), found

    def _new(self, run: bytes) -> int:
        bucket = zlib.crc32(run) % self.buckets
        if len(self._known) <= self.keep:
            self._known[run] = bucket
        return bucket


def packed(docs: DataFrame, grams: int, buckets: int, block: int = 1 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The texts' buckets in blocks of ``ids, words, offsets, stream``: a block ends after ``block`` buckets, and a text is whole in one.

    ``offsets`` has one entry more than there are texts; ``stream`` holds 16-bit
    numbers in little-endian order.
    """
    if not 0 < buckets <= 1 << 16:
        raise ValueError("a bucket must go into 16 bits")

    def make():
        buckets_of = Hasher(grams, buckets)

        def step(batch: pa.RecordBatch):
            ids, words, offsets, stream = [], [], [0], array("H")

            def done():
                data = np.frombuffer(stream, np.uint16).astype("<u2").tobytes()
                return [[ids], [words], [offsets], [data]]

            for doc_id, data in zip(batch.column(0).to_pylist(), byte_values(batch.column(1))):
                n, found = buckets_of(data)
                ids.append(doc_id)
                words.append(n)
                stream.extend(found)
                offsets.append(len(stream))
                if len(stream) >= block:
                    yield done()
                    ids, words, offsets, stream = [], [], [0], array("H")
            if ids:
                yield done()

        return step

    longs = pa.list_(pa.int64())
    return map_rows(texts(docs, id_col, text_col), [("ids", longs), ("words", longs), ("offsets", longs), ("stream", pa.binary())], make)


def runs(stream: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted stream, run-length encoded: its distinct values and how often each is there."""
    if not len(stream):
        return stream, np.zeros(0, np.int64)
    held = np.sort(stream, kind="stable")  # a radix sort for 16 bits
    starts = np.concatenate([[0], np.flatnonzero(held[1:] != held[:-1]) + 1])
    return held[starts], np.diff(np.concatenate([starts, [len(held)]]))


def counted(blocks: DataFrame) -> DataFrame:
    """How often each bucket is in the blocks: ``bucket, n``. A task merges its blocks' runs, Spark those of the tasks."""

    def count(batches):
        held_at, held = np.zeros(0, np.uint16), np.zeros(0, np.int64)
        for batch in batches:
            for data in byte_values(batch.column(0)):
                at, n = runs(np.frombuffer(data, "<u2"))
                both, where = np.unique(np.concatenate([held_at, at]), return_inverse=True)
                merged = np.zeros(len(both), np.int64)
                np.add.at(merged, where, np.concatenate([held, n]))
                held_at, held = both, merged
        yield pa.RecordBatch.from_arrays([pa.array(held_at.astype(np.int32)), pa.array(held)], names=["bucket", "n"])

    return blocks.select("stream").mapInArrow(count, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """Each bucket's gain: 1000 times the log of its smoothed share of the target over that of the source, floored."""
    counts = np.zeros((2, buckets))
    for side, rows in enumerate((source, target)):
        for r in rows.collect():  # a row for each bucket, at most 2^16
            counts[side, r.bucket] = r.n
    every = counts.sum(axis=1) + buckets
    return np.array([math.floor(1000 * math.log((t + 1) * every[0] / ((s + 1) * every[1]))) for s, t in counts.T.tolist()], np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    """Gumbel noise from an id, times 1000, floored."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weighed(blocks: DataFrame, gain: np.ndarray, seed: int) -> DataFrame:
    """Each text's ``doc_id, n_words, n_features, weight, score``."""
    held = blocks.sparkSession.sparkContext.broadcast(gain)  # 8 bytes for each bucket

    def make():
        gain = held.value

        def step(batch: pa.RecordBatch):
            columns = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), byte_values(batch.column(3)))
            for ids, words, offsets, data in columns:
                bounds = np.array(offsets, np.int64)
                n = np.diff(bounds)
                some = n > 0
                weight = np.zeros(len(n), np.int64)
                if some.any():
                    # Texts without features take no room, so each sum ends where the next text with some begins.
                    weight[some] = np.add.reduceat(gain[np.frombuffer(data, "<u2")], bounds[:-1][some]) // n[some]
                yield [ids, words, n, weight, weight + np.array([noise(i, seed) for i in ids], np.int64)]

        return step

    return map_rows(blocks.select("ids", "words", "offsets", "stream"), [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64()), ("score", pa.int64())], make)


def ranked(rows: DataFrame, eligible: str, percent: int) -> DataFrame:
    """The rows with ``rank``: places in the order of falling scores, ties to the smaller id, of the share drawn; null for the rest.

    ``rows`` must be stored, as places are counted in one job and given in another.
    """
    spark = rows.sparkSession
    # Scores are as many as weights and noise can differ by: some hundred thousand at most.
    counts = sorted(((r.score, r.n) for r in rows.where(eligible).groupBy("score").agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    draw, least, above = percent * sum(n for _, n in counts) // 100, None, 0
    for score, n in counts:
        if above >= draw:
            break
        least, above = score, above + n
    if least is None:
        return rows.withColumn("rank", F.lit(None).cast("bigint"))
    may = F.expr(eligible) & (F.col("score") >= least)
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("place")]
    # The place parts rows of equal score and id, so that no group of them is one range.
    part = rows.where(may).repartitionByRange(*order).sortWithinPartitions(*order)
    part = stored(part.withColumn("__at", F.monotonically_increasing_id())).withColumn("__part", F.shiftright("__at", 33))
    starts, before = [], 0
    for k, n in sorted((r[0], r[1]) for r in part.groupBy("__part").count().collect()):  # a row for each partition
        starts.append((k, before))
        before += n
    offsets = F.broadcast(spark.createDataFrame(starts, "__part bigint, __start bigint"))
    rank = F.col("__start") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    top = part.join(offsets, "__part").withColumn("rank", F.when(rank <= draw, rank))
    rest = rows.where(~F.coalesce(may, F.lit(False))).withColumn("rank", F.lit(None).cast("bigint"))
    return top.select(rest.columns).unionByName(rest)


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = 10,
    grams: int = 1,
    buckets: int = 10_000,
    least_words: int = 20,
    seed: int = 2024,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_text_col: str = "text",
) -> DataFrame:
    """Every row's ``doc_id, n_features, weight, score, rank``; ``rank`` is null for rows that are not drawn.

    ``percent`` of the rows with ``least_words`` words or more are drawn.
    """
    blocks = stored(packed(docs, grams, buckets, id_col=id_col, text_col=text_col))
    wanted = packed(target.withColumn("__id", F.lit(0).cast("bigint")), grams, buckets, id_col="__id", text_col=target_text_col)
    rows = weighed(blocks, gains(counted(blocks), counted(wanted), buckets), seed)
    rows = stored(rows.withColumn("place", F.monotonically_increasing_id()))
    return ranked(rows, f"n_words >= {int(least_words)}", percent).select("doc_id", "n_features", "weight", "score", "rank")


#: The same draw in DuckDB's SQL; the table of the CRC is made by its rule.
SQL = r"""
WITH RECURSIVE bits AS (
  SELECT CAST(i AS BIGINT) AS i, 0 AS step, CAST(i AS BIGINT) AS v FROM range(256) t(i)
  UNION ALL SELECT i, step + 1, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END FROM bits WHERE step < 8),
crc AS (SELECT list(v ORDER BY i) AS t FROM bits WHERE step = 8),
d AS (
  SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
f AS (SELECT k, unnest(w) AS w FROM d),
words AS (SELECT DISTINCT w FROM (SELECT w FROM f UNION ALL SELECT w FROM b)),
h AS (
  SELECT w, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, len(hex(encode(w))) // 2 + 1), lambda i: CAST(('0x' || substr(hex(encode(w)), 2 * i - 1, 2)) AS BIGINT))),
    lambda a, x: xor(a // 256, t[CAST(xor(a, x) & 255 AS BIGINT) + 1])), 4294967295) % 10000 AS bucket FROM words, crc),
s AS (SELECT bucket, count(*) AS n FROM f JOIN h USING (w) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM b JOIN h USING (w) GROUP BY bucket),
every AS (SELECT (SELECT coalesce(sum(n), 0) FROM s) + 10000 AS s, (SELECT coalesce(sum(n), 0) FROM t) + 10000 AS t),
g AS (
  SELECT s.bucket, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * every.s::DOUBLE / ((s.n + 1)::DOUBLE * every.t::DOUBLE))) AS BIGINT) AS gain
  FROM s LEFT JOIN t USING (bucket), every),
m AS (SELECT k, count(*) AS n, sum(gain) AS total FROM f JOIN h USING (w) JOIN g USING (bucket) GROUP BY k),
r AS (
  SELECT d.k, doc_id, len(d.w) AS n_words, coalesce(n, 0) AS n_features, CAST(coalesce((total - ((total % n) + n) % n) // n, 0) AS BIGINT) AS weight,
    CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h FROM d LEFT JOIN m USING (k)),
q AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5) / 4294967296))) AS BIGINT) AS score FROM r),
o AS (SELECT k, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM q WHERE n_words >= 20)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, CAST(score AS BIGINT) AS score,
  CASE WHEN rank <= (SELECT 10 * count(*) // 100 FROM o) THEN rank END AS rank
FROM q LEFT JOIN o USING (k)
"""
