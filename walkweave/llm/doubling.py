"""Removal of long repeated byte strings by prefix doubling in Spark, over every position.

Each position starts with the rank of its first bytes (up to 8, which are their own
rank).  A round sorts the pairs (rank, rank at an offset) and ranks them anew, so
that ranks stand for strings of twice the length; positions whose pair is unique
leave, as no longer string from there repeats.  The last offset is cut so that
ranks end at the length looked for.  Ranks are no hashes, and no task or driver
holds more than its share of the positions.

It gives the rows of ``suffix.dedup`` and moves each repeating position several
times in each round, which is many times the input; the README has the figures.

Edge cases: as in ``suffix``; rows equal in id and text are one text with copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, byte_values, stored
from .spans import finish, has_repeated_ids, row_key
from .suffix import FIELDS, what_stays

_POSITIONS = 1 << 17


def first_ranks(data: bytes, size: int) -> np.ndarray:
    """The first ``size`` bytes (8 at most) at each position as a number."""
    symbols = np.frombuffer(data, np.uint8).astype(np.uint64)
    count = len(symbols) - size + 1
    ranks = np.zeros(count, np.uint64)
    for k in range(size):
        ranks = ranks << np.uint64(8) | symbols[k : k + count]
    return ranks.view(np.int64)


def _ranked(pairs: DataFrame) -> DataFrame:
    """Positions whose pair repeats, with the pair's place among all sorted pairs as their rank."""
    repeating = pairs.groupBy("r", "s").agg(F.sum("copies").alias("n")).where("n > 1").select("r", "s")
    numbers = stored(repeating.repartitionByRange("r", "s").sortWithinPartitions("r", "s").withColumn("rank", F.monotonically_increasing_id()))
    return stored(pairs.join(numbers, ["r", "s"]).select("key", "p", "copies", F.col("rank").alias("r")))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200) -> DataFrame:
    """What stays of each text: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``."""
    bounded_batches(docs.sparkSession)
    repeated = has_repeated_ids(docs, id_col)
    text = F.col(f"`{text_col}`").cast("string")
    base = docs.select(row_key(docs, id_col, text_col, repeated).alias("key"), F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), text.alias("text"))
    texts = base.where(F.octet_length("text") >= length)
    texts = texts.groupBy("key", "text").agg(F.count("*").alias("copies")) if repeated else texts.select("key", "text", F.lit(1).cast("bigint").alias("copies"))
    size = 1 << min(3, length.bit_length() - 1)

    def positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, data, copies in zip(batch.column(0).to_pylist(), byte_values(batch.column(1)), batch.column(2).to_pylist()):
                ranks = first_ranks(data, size)
                for at in range(0, len(ranks), _POSITIONS):
                    part = ranks[at : at + _POSITIONS]
                    columns = [np.full(len(part), key, np.int64), np.arange(at, at + len(part), dtype=np.int32), np.full(len(part), copies, np.int64), part]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "p", "copies", "r"])

    places = _ranked(texts.mapInArrow(positions, "key bigint, p int, copies bigint, r bigint").withColumn("s", F.lit(0).cast("bigint")))
    while size < length:
        offset = min(size, length - size)
        ahead = places.select("key", (F.col("p") - offset).alias("p"), F.col("r").alias("s"))
        places = _ranked(places.join(ahead, ["key", "p"]))
        size += offset
    return finish(base, places.select("key", F.col("p").alias("p1"), (F.col("p") + length).cast("int").alias("p2")), FIELDS, what_stays)
