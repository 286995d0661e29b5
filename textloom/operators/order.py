"""Positions of rows in a total order, without bringing a group or the table into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import written


def ranked(df: DataFrame, by: list[str], order: list[Column], into: str = "position") -> DataFrame:
    """`df` with each row's place from 0 within its group `by` (no nulls there), in the order given.

    Rows are dealt by ranges of group and order, so a large group spreads over
    tasks; a place is the row's number in its range plus the rows of its group
    in earlier ranges, of which there is one count for each group and range.
    Rows equal in `by` and `order` get different places, in any order.
    """
    keys = [F.col(c) for c in by]
    dealt = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    held = written(dealt.withColumn("_at", F.monotonically_increasing_id()), "ranked").withColumn("_part", F.shiftright("_at", 33))
    counts = held.groupBy(*by, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*by, "_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    return held.join(starts, [*by, "_part"]).withColumn(into, F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")
