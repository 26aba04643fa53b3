"""Appending edges from a stream: an addition of this package, as the operators themselves are batch.

Each micro-batch gets content ids and is written under its own batch id, so that a replayed batch overwrites
itself; readers merge by edge id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from provrank.operators.upsert import merge_edges
from provrank.schema import with_edge_ids


def append_edges(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """stream has src, rel, dst, weight."""

    def write(batch: DataFrame, number: int) -> None:
        with_edge_ids(batch).withColumn("seq", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merged(spark, path: str) -> DataFrame:
    return merge_edges(spark.read.parquet(path).drop("batch"))
