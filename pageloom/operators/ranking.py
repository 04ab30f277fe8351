"""Positions within groups that may be too large for one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pageloom.session import cut


def positions(
    df: DataFrame, group: str, order: Sequence[Column], name: str = "position"
) -> DataFrame:
    """Adds the 1-based position of each row in its group, in the total order given.

    Rows are range-partitioned by group and order, so a group of any size is spread over tasks
    and only numbered piece by piece; the sizes of the pieces before (one row for each group and
    task) are then added. The pieces are written once, since sampling the ranges anew would move
    their borders.
    """
    pieces = cut(
        df.repartitionByRange(F.col(group), *order).withColumn("_piece", F.spark_partition_id())
    )
    before = W.partitionBy(group).orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)
    starts = (
        pieces.groupBy(group, "_piece")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    local = W.partitionBy(group, "_piece").orderBy(*order)
    return (
        pieces.withColumn("_local", F.row_number().over(local))
        .join(starts, [group, "_piece"])
        .withColumn(name, F.col("_start") + F.col("_local"))
        .drop("_piece", "_local", "_start")
    )
