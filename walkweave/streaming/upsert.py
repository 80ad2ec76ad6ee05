"""A walk store kept up to date by a stream of entities."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def follow(entities: DataFrame, extract: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Extracts the walks of each micro-batch of entities and replaces these entities' part of the store at ``path``.

    The store is written as one folder for each batch (``batch=N``), so that a
    batch done again after a failure overwrites its own folder alone; readers
    take an entity's walks of its latest batch (:func:`current`).
    """

    def write(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            extract(batch.dropDuplicates(["entity"])).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = entities.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def current(store: DataFrame) -> DataFrame:
    """The walks of each entity's latest batch."""
    from pyspark.sql import functions as F

    latest = store.groupBy("entity").agg(F.max("batch").alias("batch"))
    return store.join(latest, ["entity", "batch"], "left_semi").drop("batch")
