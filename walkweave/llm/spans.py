"""Documents under a key, and found spans brought back to them."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, map_rows
from .sketch import Sketch, bits_for, of_column


def has_repeated_ids(docs: DataFrame, id_col: str) -> bool:
    """Whether any id is null or on several rows."""
    ids = docs.select(F.col(f"`{id_col}`").alias("id")).groupBy("id").count()
    return bool(ids.where("count > 1 OR id IS NULL").take(1))


def row_key(docs: DataFrame, id_col: str, text_col: str, repeated: bool | None = None) -> Column:
    """A key that rows share only if id and text are equal: the id itself where ids are unique, else a hash of both."""
    own = F.col(f"`{id_col}`").cast("bigint")
    return F.xxhash64(own, F.col(f"`{text_col}`").cast("string")) if (has_repeated_ids(docs, id_col) if repeated is None else repeated) else own


def joined_runs(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs that spans, in any order, make together."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate(([True], starts[1:] > ends[:-1]))
    return starts[new], ends[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(ends) - 1]))]


def _merged(batches):
    """Lists of spans become lists of maximal runs."""
    for batch in batches:
        runs = [joined_runs(a.values.to_numpy(), b.values.to_numpy()) for a, b in zip(batch.column(1), batch.column(2))]
        kind = pa.list_(pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in runs], kind), pa.array([y for _, y in runs], kind)], names=["key", "p1", "p2"])


def finish(base: DataFrame, spans: DataFrame, fields: list[tuple[str, pa.DataType]], step: Callable[[pa.RecordBatch], list]) -> DataFrame:
    """Each row of ``base`` (``key`` first, other columns) with its spans, through ``step``.

    ``spans``: ``key, p1, p2``.  The step gets batches of ``base``'s columns and
    two more, lists of the spans' starts and ends (null for none).  A sketch of
    the keys with spans tells which rows need the join at all, so that the texts
    of all others are not moved.
    """
    listed = spans.groupBy("key").agg(F.collect_list(F.struct("p1", "p2")).alias("s"))
    grouped = checkpointed(listed.select("key", F.col("s.p1").alias("p1"), F.col("s.p2").alias("p2")).mapInArrow(_merged, "key bigint, p1 array<int>, p2 array<int>"))
    # At most 128 MB; with more keys than that has room for, more texts than need be go through the join.
    marked = of_column(grouped.select(F.xxhash64("key").alias("h")), ["h"], bits_for(grouped.count(), 30, 16))
    shared = base.sparkSession.sparkContext.broadcast(marked)
    hashed = base.withColumn("h", F.xxhash64("key"))
    n = len(base.columns)

    def marks(batch: pa.RecordBatch, sketch: Sketch) -> np.ndarray:
        found = sketch.holds(batch.column(n).to_numpy(zero_copy_only=False).view(np.uint64))
        return found & ~np.asarray(batch.column(0).is_null())

    def with_spans(batches):
        for batch in batches:
            yield batch.filter(pa.array(marks(batch, shared.value))).select(list(range(n)))

    def without():
        none = pa.list_(pa.int32())

        def run(batch: pa.RecordBatch):
            rest = batch.filter(pa.array(~marks(batch, shared.value)))
            columns = [*rest.columns[:n], pa.nulls(rest.num_rows, none), pa.nulls(rest.num_rows, none)]
            yield step(pa.RecordBatch.from_arrays(columns, names=[str(i) for i in range(n + 2)]))

        return run

    def joined():
        def run(batch: pa.RecordBatch):
            yield step(batch)

        return run

    moved = hashed.mapInArrow(with_spans, base.schema).join(grouped, "key", "left").select(*base.columns, "p1", "p2")
    return map_rows(hashed, fields, without).union(map_rows(moved, fields, joined))
