"""Helpers that the training-data operators share."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows in an Arrow batch at most: texts can be long, and a worker holds a batch and what it makes of it at once.
BATCH_ROWS = 2_000


def bounded_batches(spark: SparkSession) -> None:
    """Lowers the session's rows in an Arrow batch to ``BATCH_ROWS``."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: Column) -> DataFrame:
    """The id and the text under fixed names, so that no other column of ``docs`` can clash."""
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), *more)


def byte_values(column: pa.Array) -> list[bytes | None]:
    """A string column's values as UTF-8 bytes; nothing is decoded."""
    return column.cast(pa.binary()).to_pylist()


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def arrow_schema(ddl: list[tuple[str, pa.DataType]]) -> pa.Schema:
    return pa.schema(ddl)


#: SQL names of the Arrow types in use.
SQL_TYPES = {
    pa.int64(): "bigint",
    pa.int32(): "int",
    pa.string(): "string",
    pa.bool_(): "boolean",
    pa.float64(): "double",
    pa.binary(): "binary",
    pa.list_(pa.int64()): "array<bigint>",
    pa.list_(pa.int32()): "array<int>",
    pa.list_(pa.string()): "array<string>",
}


def map_rows(df: DataFrame, fields: list[tuple[str, pa.DataType]], make: Callable[[], Callable[[pa.RecordBatch], Iterable[list]]]) -> DataFrame:
    """``mapInArrow`` with columns given as lists.

    ``make`` runs once in a task and returns the function that turns a batch
    into columns (or an iterable of column lists, for several output batches).
    """
    bounded_batches(df.sparkSession)
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            if batch.num_rows:
                for columns in step(batch):
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)

    return df.mapInArrow(run, ", ".join(f"`{n}` {SQL_TYPES[t]}" for n, t in fields))


def keep_rows(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], list[bool]]]) -> DataFrame:
    """The rows for which the task's function says True, with all their columns."""
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(step(batch), type=pa.bool_()))

    return df.mapInArrow(run, df.schema)


def _shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session's cluster; where none is set, as in tests, one below the warehouse."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.sql.warehouse.dir") + "/checkpoints")
    return context._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage by a reliable checkpoint in the shared folder."""
    _shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Cut lineage by a Parquet table in the shared folder, for results that are large: its files are compressed."""
    path = f"{_shared_folder(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
