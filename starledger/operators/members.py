"""Attributing facts to dimension members."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def resolve_member(sales: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """Facts with ``key`` set to NULL where the dimension does not know it.

    Grouping the result by ``key`` gives one group per member plus one group for
    all unattributed facts, with distinct counts that are right across it. Only
    the key column of the dimension takes part, so the side to ship is as narrow
    as it can be (Catalyst broadcasts it when its size allows), and later
    shuffles carry one integer in place of the member's names.
    """
    known = dimension.select(F.col(key).alias("_known_key"))
    others = [c for c in sales.columns if c != key]
    return sales.join(known, sales[key] == known["_known_key"], "left").select(
        F.col("_known_key").alias(key), *others
    )


def describe_member(
    metrics: DataFrame, dimension: DataFrame, key: str, attributes: list[str]
) -> DataFrame:
    """Add member attributes to rows already aggregated by ``key``."""
    return metrics.join(dimension.select(key, *attributes), key, "left")


def additive_by_attributes(
    sales: DataFrame,
    dimension: DataFrame,
    key: str,
    attributes: list[str],
    sums: dict[str, str],
    how: str = "left",
) -> DataFrame:
    """Sums per attribute combination: ``sums`` maps result name to fact column.

    Sums are mergeable, so the facts shrink to one row per key before they meet
    the dimension; the join never sees fact-grain rows and a hot key is folded
    on the map side.
    """
    by_key = sales.groupBy(key).agg(*[F.sum(c).alias(name) for name, c in sums.items()])
    described = by_key.join(dimension.select(key, *attributes), key, how)
    merged: list[Column] = [F.sum(name).alias(name) for name in sums]
    return described.groupBy(*attributes).agg(*merged)


def additive_by_member(
    sales: DataFrame, dimension: DataFrame, key: str, sums: dict[str, str]
) -> DataFrame:
    """Sums per known member, and for all unattributed facts together, with the
    same early fold: the key is resolved on one row per key found in the facts."""
    by_key = sales.groupBy(key).agg(*[F.sum(c).alias(name) for name, c in sums.items()])
    return (
        resolve_member(by_key, dimension, key)
        .groupBy(key)
        .agg(*[F.sum(name).alias(name) for name in sums])
    )
