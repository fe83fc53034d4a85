"""Sales along the calendar. Undated sales take no part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starledger.functions.semantics import asc, int_avg, int_div, month_start
from starledger.operators.distinct import aggregate_distinct_apart
from starledger.operators.periods import sign_label, timeline, with_change
from starledger.operators.sketches import estimate, merged, with_sketches
from starledger.star import Star, dated_sales


def _dated(star: Star) -> DataFrame:
    return dated_sales(star.sales)


def _by_month(star: Star) -> DataFrame:
    return _dated(star).withColumn("month", month_start(F.col("order_date")))


def _by_year(star: Star) -> DataFrame:
    return _dated(star).withColumn("order_year", F.year("order_date"))


def _sales() -> Column:
    return F.sum("sales_amount").alias("total_sales")


def _customers() -> Column:
    return F.count_distinct("customer_key").alias("total_customers")


def _quantity() -> Column:
    return F.sum("quantity").alias("total_quantity")


def _avg_price() -> Column:
    return int_avg(F.col("price")).alias("avg_price")


def _month_text() -> Column:
    return F.date_format("month", "yyyy-MM").alias("order_month")


def monthly_rollup(star: Star) -> DataFrame:
    """One row per month: exact sums, and sketches of its orders and customers.

    It takes one pass over the facts and is small. Kept as a table, it answers for months, years and
    seasons with estimated distinct counts, and rollups of separate loads can be merged.
    """
    sums = [_sales(), _quantity(), F.sum("price").alias("price_sum"), F.count("price").alias("price_count")]
    return with_sketches(_by_month(star), ["month"], sums, {"orders": "order_number", "customers": "customer_key"})


def _rolled_up(rollup: DataFrame, by: Column) -> DataFrame:
    """A rollup merged to coarser periods, with its counts estimated."""
    return rollup.groupBy(by).agg(
        F.sum("total_sales").alias("total_sales"),
        F.sum("total_quantity").alias("total_quantity"),
        estimate(merged("orders")).alias("total_orders"),
        estimate(merged("customers")).alias("total_customers"),
        int_div(F.sum("price_sum"), F.sum("price_count")).alias("avg_price"),
    )


def monthly_trend(star: Star, approx: bool = False, rollup: DataFrame | None = None) -> DataFrame:
    """``approx`` estimates the customers from sketches, of a kept ``rollup`` if one is given."""
    monthly = (
        _rolled_up(rollup or monthly_rollup(star), F.col("month"))
        if approx
        else _by_month(star).groupBy("month").agg(_sales(), _customers(), _quantity(), _avg_price())
    )
    return (
        monthly.orderBy("month")
        .select(_month_text(), "total_sales", "total_customers", "total_quantity", "avg_price")
    )


def yearly_trend(star: Star, approx: bool = False, rollup: DataFrame | None = None) -> DataFrame:
    """``approx`` estimates orders and customers, as in :func:`monthly_trend`."""
    yearly = (
        _rolled_up(rollup or monthly_rollup(star), F.year("month").alias("order_year"))
        if approx
        else aggregate_distinct_apart(
            _by_year(star),
            "order_year",
            [_sales(), _quantity(), _avg_price()],
            distinct={"total_orders": "order_number", "total_customers": "customer_key"},
        )
    )
    return (
        yearly.select(
            "order_year",
            "total_sales",
            "total_customers",
            "total_quantity",
            "total_orders",
            "avg_price",
        )
        .orderBy("order_year")
    )


def seasonality(star: Star, approx: bool = False, rollup: DataFrame | None = None) -> DataFrame:
    """Calendar months added up over all years; ``approx`` as in :func:`yearly_trend`."""
    # 2000 stands for any year: the name needs a date, the grouping only the number.
    name = F.date_format(F.make_date(F.lit(2000), "month_number", F.lit(1)), "MMMM")
    by_month = _dated(star).withColumn("month_number", F.month("order_date"))
    seasons = (
        _rolled_up(rollup or monthly_rollup(star), F.month("month").alias("month_number"))
        if approx
        else aggregate_distinct_apart(
            by_month,
            "month_number",
            [_sales(), _quantity()],
            distinct={"total_orders": "order_number", "total_customers": "customer_key"},
        )
    )
    return (
        seasons.select(
            "month_number",
            name.alias("month_name"),
            "total_sales",
            "total_customers",
            "total_quantity",
            "total_orders",
        )
        .orderBy("month_number")
    )


def month_over_month(star: Star, exact: bool = False) -> DataFrame:
    """Change from the previous month with sales, and year-to-date sales.

    ``yearly_total_customers`` adds up the monthly customer counts, so a customer
    counts once per month.
    """
    monthly = (
        _by_month(star)
        .groupBy("month")
        .agg(
            F.sum("sales_amount").alias("monthly_total_sales"),
            F.count_distinct("customer_key").alias("monthly_total_customers"),
        )
        .withColumn("year", F.year("month"))
    )
    compared = with_change(
        monthly,
        "monthly_total_sales",
        timeline("month"),
        previous="previous_month_sales",
        change="month_over_month_diff",
        growth="month_over_month_growth_pct",
        exact=exact,
    )
    return (
        compared.withColumn("ytd_sales", F.sum("monthly_total_sales").over(timeline("month", "year")))
        .withColumn(
            "yearly_total_customers",
            F.sum("monthly_total_customers").over(Window.partitionBy("year")),
        )
        .orderBy("month")
        .select(
            _month_text(),
            "monthly_total_sales",
            "previous_month_sales",
            "month_over_month_diff",
            "month_over_month_growth_pct",
            "ytd_sales",
            "monthly_total_customers",
            "yearly_total_customers",
        )
    )


def monthly_running(star: Star) -> DataFrame:
    """Running total, trailing three-month average, and the three-month total
    centred on the month."""
    monthly = _by_month(star).groupBy("month").agg(_sales(), _avg_price())
    along = timeline("month")
    sales = F.col("total_sales")
    return (
        monthly.withColumn("running_total_sales", F.sum(sales).over(along))
        .withColumn("rolling_3_month_avg_sales", int_avg(sales, along.rowsBetween(-2, 0)))
        .withColumn("rolling_3_month_total", F.sum(sales).over(along.rowsBetween(-1, 1)))
        .withColumn("cumulative_avg_price", int_avg(F.col("avg_price"), along))
        .orderBy("month")
        .select(
            _month_text(),
            "total_sales",
            "running_total_sales",
            "rolling_3_month_avg_sales",
            "rolling_3_month_total",
            "avg_price",
            "cumulative_avg_price",
        )
    )


def yearly_running(star: Star) -> DataFrame:
    along = timeline("order_year")
    return (
        _by_year(star)
        .groupBy("order_year")
        .agg(_sales(), _avg_price())
        .select(
            "order_year",
            "total_sales",
            F.sum("total_sales").over(along).alias("running_total_sales"),
            int_avg(F.col("avg_price"), along).alias("cumulative_avg_price"),
        )
        .orderBy("order_year")
    )


def product_year_over_year(star: Star, exact: bool = False) -> DataFrame:
    """Each product's years compared with its previous year and its own average.

    Only sales of known products count. The windows run per product, over at
    most one row per year and category.
    """
    by_key_year = (
        _by_year(star)
        .groupBy("product_key", "order_year")
        .agg(F.sum("sales_amount").alias("year_sales"))
    )
    names = star.products.select("product_key", "product_name", "category")
    yearly = (
        by_key_year.join(names, "product_key")
        .groupBy("product_name", "category", "order_year")
        .agg(F.sum("year_sales").alias("current_year_sales"))
    )
    along = Window.partitionBy("product_name").orderBy(*asc("order_year", "category"))
    compared = with_change(
        yearly,
        "current_year_sales",
        along,
        previous="previous_year_sales",
        change="yoy_sales_diff",
        growth="yoy_growth_pct",
        exact=exact,
    )
    overall = int_avg(F.col("current_year_sales"), Window.partitionBy("product_name"))
    return (
        compared.withColumn(
            "yoy_trend", sign_label(F.col("yoy_sales_diff"), "Growth", "Decline", "No Change")
        )
        .withColumn("product_avg_sales", overall)
        .withColumn("diff_from_avg", F.col("current_year_sales") - F.col("product_avg_sales"))
        .withColumn(
            "performance_vs_avg",
            sign_label(F.col("diff_from_avg"), "Above Average", "Below Average", "At Average"),
        )
        .select(
            "order_year",
            "product_name",
            "category",
            "current_year_sales",
            "previous_year_sales",
            "yoy_sales_diff",
            "yoy_growth_pct",
            "yoy_trend",
            "product_avg_sales",
            "diff_from_avg",
            "performance_vs_avg",
        )
        .orderBy(*asc("product_name", "order_year", "category"))
    )
