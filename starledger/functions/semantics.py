"""Arithmetic and calendar rules that decide the numbers.

Money and counts are integers here, and integer arithmetic stays integral:
division and averages truncate toward zero, and calendar differences count the
boundaries crossed rather than the time elapsed.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


def as_of_date(as_of: date | None) -> Column:
    """The reporting date: a literal when pinned, else today."""
    return F.current_date() if as_of is None else F.lit(as_of)


def int_div(numerator: Column, denominator: Column) -> Column:
    """Quotient truncated toward zero; NULL when the denominator is zero."""
    return F.call_function("div", numerator, F.nullif(denominator, F.lit(0)))


def int_avg(x: Column, over: WindowSpec | None = None) -> Column:
    """Average of an integer column truncated to an integer.

    Built from an exact sum and count, so the result does not depend on the
    order in which partitions are merged.
    """
    total, n = F.sum(x), F.count(x)
    if over is not None:
        total, n = total.over(over), n.over(over)
    return int_div(total, n)


def ratio(numerator: Column, denominator: Column) -> Column:
    """Floating-point quotient; NULL when the denominator is zero."""
    return numerator.cast("double") / F.nullif(denominator, F.lit(0))


def ratio2(numerator: Column, denominator: Column) -> Column:
    return F.round(ratio(numerator, denominator), 2)


def percent(part: Column, whole: Column) -> Column:
    """``part`` as a percentage of ``whole``, to two decimals."""
    return F.round(ratio(part, whole) * 100, 2)


def growth_percent(change: Column, base: Column, exact: bool = False) -> Column:
    """Change relative to ``base`` in percent.

    By default the ratio is an integer division, taken before scaling, so the
    outcome is a multiple of 100. ``exact=True`` keeps the fraction.
    """
    return percent(change, base) if exact else int_div(change, base) * 100


def years_between(start: Column, end: Column) -> Column:
    """Year boundaries crossed: Dec 31 to Jan 1 is one year."""
    return F.year(end) - F.year(start)


def months_between(start: Column, end: Column) -> Column:
    """Month boundaries crossed: Jan 31 to Feb 1 is one month."""
    return years_between(start, end) * 12 + F.month(end) - F.month(start)


def full_name(first: Column, last: Column) -> Column:
    """Both names around a blank; a missing name counts as empty text."""
    return F.concat(F.coalesce(first, F.lit("")), F.lit(" "), F.coalesce(last, F.lit("")))


def month_start(d: Column) -> Column:
    return F.trunc(d, "MM")


def subject_name(table_name: Column) -> Column:
    """``dim_customers`` -> ``Customers``: drop the first prefix, capitalise."""
    bare = F.substr(table_name, F.instr(table_name, "_") + 1)
    return F.concat(F.upper(F.left(bare, F.lit(1))), F.lower(F.substr(bare, F.lit(2))))


def desc(*columns: str) -> list[Column]:
    """Descending with NULL as the lowest value."""
    return [F.col(c).desc_nulls_last() for c in columns]


def asc(*columns: str) -> list[Column]:
    """Ascending with NULL as the lowest value."""
    return [F.col(c).asc_nulls_first() for c in columns]


def dense_rank_desc(column: str, partition_by: tuple[str, ...] = ()) -> Column:
    """Dense rank from the largest value down, over a small set of groups."""
    window = Window.partitionBy(*partition_by).orderBy(*desc(column))
    return F.dense_rank().over(window).cast("long")
