"""Several distinct counts in one grouping."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starledger.sources.staging import stage


def aggregate_distinct_apart(
    facts: DataFrame, by: str | None, measures: list[Column], distinct: dict[str, str]
) -> DataFrame:
    """Group ``facts`` by one column (or as a whole) with several distinct counts.

    ``distinct`` maps result name to counted column. Two distinct counts in one
    aggregation make Spark copy every fact once per counted column, each copy as
    wide as all measures together, before anything is folded. Here the first
    count goes with the measures and each other count is an aggregation of its
    own over two narrow columns; the results meet at group grain. Every count
    shuffles by (group, counted value), so a dominant group stays spread out.
    ``facts`` are read once per count; :meth:`Star.for_passes` writes them out where that pays.
    """
    (first, column), *others = distinct.items()
    together = [F.count_distinct(column).alias(first), *measures]
    if by is None:
        counts = [
            facts.agg(F.count_distinct(c)).scalar().alias(name) for name, c in others
        ]
        return facts.agg(*together).select("*", *counts)
    result = facts.groupBy(by).agg(*together)
    for name, c in others:
        count = facts.groupBy(F.col(by).alias("_group")).agg(F.count_distinct(c).alias(name))
        result = result.join(count, F.col(by).eqNullSafe(F.col("_group"))).drop("_group")
    return result


def count_distinct_of_best(
    best: DataFrame, keyed: DataFrame, facts: DataFrame, key: str, groups: list[str], column: str, name: str
) -> DataFrame:
    """``best`` with a distinct count over the facts of its groups alone.

    ``keyed`` holds the groups of each value of ``key`` found in the facts. Only the keys of
    the groups in ``best`` go to the facts, so just these facts are shuffled for the
    count. A NULL group may bring many keys: they are written out, and
    Spark's size check of that table decides how it joins.
    """
    best = stage(best)

    def same(left: DataFrame, right: DataFrame) -> Column:
        return reduce(and_, [left[g].eqNullSafe(right[g]) for g in groups])

    wanted = best.select(*groups)
    winners = keyed.join(wanted, same(keyed, wanted), "left_semi")
    winners = stage(winners.select(F.col(key).alias("_winner"), *[F.col(g).alias(f"_{g}") for g in groups]))
    counted = (
        facts.select(key, column)
        .join(winners, F.col(key).eqNullSafe(F.col("_winner")))
        .groupBy(*[f"_{g}" for g in groups])
        .agg(F.count_distinct(column).alias(name))
    )
    found = reduce(and_, [F.col(g).eqNullSafe(F.col(f"_{g}")) for g in groups])
    return (
        best.join(counted, found, "left")
        .drop(*[f"_{g}" for g in groups])
        .withColumn(name, F.coalesce(name, F.lit(0).cast("long")))
    )
