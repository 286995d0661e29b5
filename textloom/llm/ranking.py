"""Positions of rows in a total order, by small Arrow batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from ..operators import order as library
from .common import small_batches


def ranked(df: DataFrame, by: list[str], order: list[Column], into: str = "position") -> DataFrame:
    """See `operators.order.ranked`."""
    small_batches(df.sparkSession)
    return library.ranked(df, by, order, into)
