"""Numbering the rows of a total order without one task for all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from provrank.storage import materialize


def numbered(df: DataFrame, keys: list[str], name: str, start: int = 1) -> DataFrame:
    """df, written, with name: start and on in the ascending order of keys, which must tell all rows apart.

    Rows are sorted by range and numbered within each range; a range's first number is the count of those before it.
    """
    ordered = materialize(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__part", F.spark_partition_id()), "ordered")
    rn = F.row_number().over(Window.partitionBy("__part").orderBy(*keys))
    sizes = ordered.groupBy("__part").agg(F.count("*").alias("__n"))
    # a row for each range: as many as there are shuffle partitions
    before = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    out = ordered.withColumn("__rn", rn).join(F.broadcast(before), "__part").withColumn(name, (F.col("__before") + F.col("__rn") + (start - 1)).cast("long")).drop("__part", "__rn", "__before")
    out.written_to = ordered.written_to  # for release(), once out is written elsewhere
    return out
