"""Shares of a total and total rows over a grouped frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starledger.functions.semantics import asc, desc


def over_groups(measure: str) -> Column:
    """Sum of a measure over all rows of a grouped frame.

    For frames with one row per band, country, category or subcategory: those few
    rows meet in one task, and nothing below the grouping runs a second time. For
    a frame with a row per product or customer use ``SlicedOrder`` or
    :func:`over_members`.
    """
    return F.sum(measure).over(Window.partitionBy())


def over_members(by_member: DataFrame, measure: str) -> Column:
    """The same sum as a scalar subquery, for a frame that may be large.

    Spark runs the subquery beside the main query. What they share is the first
    exchange above the facts, so this suits frames that start by folding the
    facts to one row per key; a join at fact grain would run twice.
    """
    return by_member.agg(F.sum(measure)).scalar()


def with_total_row(detail: DataFrame, total: DataFrame, sort_by: str) -> DataFrame:
    """Detail rows and their total row, sorted together, largest first."""
    typed = [F.col(f.name).cast(f.dataType) for f in detail.schema if f.name in total.columns]
    both = detail.unionByName(total.select(*typed), allowMissingColumns=True)
    return both.orderBy(*desc(sort_by), *asc(detail.columns[0]))
