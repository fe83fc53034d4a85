"""Customers and products grouped into bands."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starledger.functions import segments
from starledger.functions.segments import Thresholds
from starledger.functions.semantics import (
    as_of_date,
    asc,
    desc,
    int_avg,
    months_between,
    percent,
    years_between,
)
from starledger.operators.members import additive_by_member, describe_member, resolve_member
from starledger.operators.totals import over_groups
from starledger.star import Star


def _summarise(banded: DataFrame, band: str, measures: dict[str, Column], share_of: str, share: str):
    """Measures per band, and each band's share of one of them."""
    grouped = banded.groupBy(band).agg(*[m.alias(name) for name, m in measures.items()])
    return grouped.withColumn(share, percent(F.col(share_of), over_groups(share_of)))


def age_groups(star: Star, as_of: date | None = None) -> DataFrame:
    per_customer = star.sales.groupBy("customer_key").agg(
        F.sum("sales_amount").alias("customer_sales"),
        F.count_distinct("order_number").alias("customer_orders"),
    )
    age = years_between(F.col("birthdate"), as_of_date(as_of))
    banded = describe_member(per_customer, star.customers, "customer_key", ["birthdate"]).withColumn(
        "age_group", segments.age_group(age)
    )
    summary = _summarise(
        banded,
        "age_group",
        {
            "total_customers": F.count("customer_key"),
            "total_sales": F.sum("customer_sales"),
            "total_orders": F.sum("customer_orders"),
            "avg_sales_per_customer": int_avg(F.col("customer_sales")),
        },
        share_of="total_sales",
        share="sales_percentage",
    )
    return summary.orderBy(*desc("total_sales"), *asc("age_group"))


def cost_ranges(star: Star) -> DataFrame:
    banded = star.products.select("product_key", segments.cost_range(F.col("cost")).alias("cost_range"))
    summary = _summarise(
        banded,
        "cost_range",
        {"total_products": F.count("product_key")},
        share_of="total_products",
        share="product_percentage",
    )
    labels = [label for _, label in segments.COST_BELOW] + [segments.COST_OTHERWISE]
    return summary.orderBy(segments.label_order(F.col("cost_range"), labels).asc_nulls_first())


def product_performance(star: Star, limits: Thresholds = Thresholds()) -> DataFrame:
    per_product = additive_by_member(
        star.sales, star.products, "product_key", {"product_sales": "sales_amount"}
    )
    sales = F.col("product_sales")
    summary = _summarise(
        per_product.withColumn("performance_segment", segments.performance_segment(sales, limits)),
        "performance_segment",
        {
            "total_products": F.count("product_key"),
            "avg_sales_per_product": int_avg(sales),
            "min_sales": F.min(sales),
            "max_sales": F.max(sales),
        },
        share_of="total_products",
        share="product_percentage",
    )
    return summary.orderBy(
        segments.label_order(F.col("performance_segment"), segments.PERFORMANCE).asc_nulls_first()
    )


def customer_lifecycle(star: Star, limits: Thresholds = Thresholds()) -> DataFrame:
    """Sales of unknown customers form one nameless customer: it weighs in the
    averages of its segment but is not counted as a customer."""
    per_customer = (
        resolve_member(star.sales, star.customers, "customer_key")
        .groupBy("customer_key")
        .agg(
            F.sum("sales_amount").alias("spending"),
            F.count_distinct("order_number").alias("orders"),
            months_between(F.min("order_date"), F.max("order_date")).alias("lifespan_months"),
        )
    )
    segment = segments.lifecycle_segment(F.col("lifespan_months"), F.col("spending"), limits)
    summary = _summarise(
        per_customer.withColumn("customer_segment", segment),
        "customer_segment",
        {
            "total_customers": F.count("customer_key"),
            "avg_spending": int_avg(F.col("spending")),
            "avg_orders": int_avg(F.col("orders")),
            "avg_lifespan_months": int_avg(F.col("lifespan_months")),
        },
        share_of="total_customers",
        share="customer_percentage",
    )
    return summary.orderBy(
        segments.label_order(F.col("customer_segment"), segments.LIFECYCLE).asc_nulls_first()
    )
