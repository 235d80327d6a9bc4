"""Trajectory rows as a stream of files: the checkpoint remembers what is done, in place of a listing of outputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def follow(spark: SparkSession, source: str, schema: str, checkpoint: str, work: Callable[[DataFrame, int], None], once: bool = True, **options) -> StreamingQuery:
    """Give the new rows of a folder of Parquet files to work(batch, id). With once, stop when all there is has been done."""
    stream = spark.readStream.schema(schema).options(**options).parquet(source)
    writer = stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
