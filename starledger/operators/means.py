"""Averages that do not depend on the order in which partitions are merged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def mean_quotient(facts: DataFrame, by: str, numerator: str, denominator: str, name: str) -> DataFrame:
    """Mean of numerator / denominator per group, over rows that have both and no zero below.

    Floating-point sums depend on the order of their terms. So the integer numerators are first added
    up exactly per (group, denominator), on the map side already, and each sum is divided once; these
    quotients are added in the order of the denominators. The result has the same bits however the facts are
    cut. It suits denominators of few values, as quantities are: a group's list has one entry per value.
    """
    whole = facts.where(F.col(numerator).isNotNull() & (F.col(denominator) != 0))
    sums = whole.groupBy(by, denominator).agg(
        F.sum(numerator).alias("_sum"), F.count(F.lit(1)).alias("_rows")
    )
    listed = sums.groupBy(by).agg(
        F.array_sort(F.collect_list(F.struct(F.col(denominator).alias("below"), F.col("_sum").alias("sum")))).alias(
            "_terms"
        ),
        F.sum("_rows").alias("_rows"),
    )
    added = F.aggregate(
        "_terms", F.lit(0.0), lambda total, term: total + term["sum"].cast("double") / term["below"].cast("double")
    )
    return listed.select(by, (added / F.col("_rows")).alias(name))
