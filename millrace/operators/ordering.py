"""Numbers and neighbours along an order of all rows, without all rows in one task: range partitions and one row of each."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.storage import stored


def _ranged(rows: DataFrame, order: str) -> DataFrame:
    """rows with `range_part`: the number of their range of the order. Written to the shared folder."""
    return stored(rows.repartitionByRange(order).withColumn("range_part", F.spark_partition_id()), "ranged")


def numbered(rows: DataFrame, order: str, name: str, start: int = 0) -> DataFrame:
    """rows with their number along a column of distinct values."""
    parts = _ranged(rows, order)
    before = Window.orderBy("range_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    offsets = parts.groupBy("range_part").agg(F.count("*").alias("size")).select("range_part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"))
    own = F.row_number().over(Window.partitionBy("range_part").orderBy(order))
    return parts.withColumn(name, own).join(F.broadcast(offsets), "range_part").withColumn(name, F.col(name) + F.col("offset") + (start - 1)).drop("range_part", "offset")


def preceded(rows: DataFrame, order: str, column: str, name: str) -> DataFrame:
    """rows with what `column`, which has no nulls, holds in the row before, along a column of distinct values."""
    parts = _ranged(rows, order)
    ends = parts.groupBy("range_part").agg(F.max_by(column, order).alias("end"))  # a row a partition
    ends = ends.select("range_part", F.lag("end").over(Window.orderBy("range_part")).alias("end"))
    own = F.lag(column).over(Window.partitionBy("range_part").orderBy(order))
    return parts.withColumn(name, own).join(F.broadcast(ends), "range_part").withColumn(name, F.coalesce(name, "end")).drop("range_part", "end")
