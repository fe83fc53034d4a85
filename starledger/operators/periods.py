"""Comparisons along a time axis.

Frames here have one row per period (and, where partitioned, per subject). A
calendar has at most 12 months in each of 9999 years, so the unpartitioned
windows of this module never see more rows than that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from starledger.functions.semantics import growth_percent


def timeline(period: str, *partition_by: str) -> WindowSpec:
    """Periods in order. The previous period is the previous one present."""
    return Window.partitionBy(*partition_by).orderBy(period)


def with_change(
    df: DataFrame,
    value: str,
    along: WindowSpec,
    previous: str,
    change: str,
    growth: str,
    exact: bool = False,
) -> DataFrame:
    """Add the previous period's value, the change from it and the growth percentage."""
    return (
        df.withColumn(previous, F.lag(value).over(along))
        .withColumn(change, F.col(value) - F.col(previous))
        .withColumn(growth, growth_percent(F.col(change), F.col(previous), exact))
    )


def sign_label(x: Column, positive: str, negative: str, otherwise: str) -> Column:
    return F.when(x > 0, positive).when(x < 0, negative).otherwise(otherwise)
