"""Session helpers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that driver and executors share; where none is set, as in tests, one below the warehouse."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.sql.warehouse.dir") + "/checkpoints")
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut by a reliable checkpoint.

    The folder is the one that the cluster shares (``spark.checkpoint.dir``);
    only where none is set, as in tests, one below the warehouse is taken.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def _place(spark: SparkSession, path: str):
    """A path and the file system that it is in."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def folders(spark: SparkSession, path: str) -> list[str]:
    """The names of what a folder holds; none where there is no such folder."""
    place, store = _place(spark, path)
    return sorted(s.getPath().getName() for s in store.listStatus(place)) if store.exists(place) else []


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder and what is in it, if it is there."""
    place, store = _place(spark, path)
    store.delete(place, True)


def stored(df: DataFrame, *by: str) -> tuple[DataFrame, str]:
    """The same rows read from a Parquet table below the shared folder, and where it is; ``by`` names columns that become folders."""
    path = f"{shared_folder(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path  # a table without rows has no files to tell its schema


def rounds_table(spark: SparkSession, schema: str):
    """A Parquet table below the shared folder that grows by rounds: a function that writes a round's rows and gives them back as stored, and one that gives all rows with their ``number``."""
    path = f"{shared_folder(spark)}/tables/{uuid.uuid4().hex}"

    def write(df: DataFrame, number: int) -> DataFrame:
        df.write.parquet(f"{path}/number={number}")
        return spark.read.schema(schema).parquet(f"{path}/number={number}")

    return write, lambda: spark.read.schema(f"{schema}, number int").option("basePath", path).parquet(path)
