"""Part-to-whole: what each category, subcategory and product adds to sales."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starledger.functions.semantics import asc, dense_rank_desc, desc, percent
from starledger.operators.members import additive_by_attributes
from starledger.operators.ranking import SlicedOrder
from starledger.operators.totals import over_groups, over_members
from starledger.sources.staging import stage
from starledger.star import Star


def _sold(star: Star, *attributes: str) -> DataFrame:
    return star.sales.join(star.products.select("product_key", *attributes), "product_key", "left")


def category_contribution(star: Star) -> DataFrame:
    grouped = (
        _sold(star, "category")
        .groupBy("category")
        .agg(
            F.sum("sales_amount").alias("category_sales"),
            F.count_distinct("order_number").alias("total_orders"),
            F.sum("quantity").alias("total_quantity"),
        )
    )
    return grouped.select(
        "*",
        over_groups("category_sales").alias("total_sales"),
        percent(F.col("category_sales"), over_groups("category_sales")).alias("sales_percentage"),
        # One row per category of the product hierarchy.
        dense_rank_desc("category_sales").alias("revenue_rank"),
    ).orderBy(*desc("category_sales"), *asc("category"))


def subcategory_contribution(star: Star) -> DataFrame:
    """Share of all sales and of the category's sales.

    The groups are written out, so that both totals come from them and not from the facts again.
    """
    grouped = stage(
        _sold(star, "category", "subcategory")
        .groupBy("category", "subcategory")
        .agg(
            F.sum("sales_amount").alias("subcategory_sales"),
            F.count_distinct("order_number").alias("total_orders"),
        )
    )
    sales, total = F.col("subcategory_sales"), over_members(grouped, "subcategory_sales")
    by_category = grouped.groupBy(F.col("category").alias("_category")).agg(
        F.sum("subcategory_sales").alias("_category_sales")
    )
    return grouped.join(by_category, F.col("category").eqNullSafe(F.col("_category"))).select(
        *grouped.columns,
        total.alias("total_sales"),
        percent(sales, total).alias("sales_percentage"),
        percent(sales, F.col("_category_sales")).alias("category_percentage"),
    ).orderBy(*desc("subcategory_sales"), *asc("category", "subcategory"))


def product_contribution(star: Star) -> DataFrame:
    """Products may be many: total and rank come from the sliced order."""
    names = ["product_name", "category", "subcategory"]
    grouped = additive_by_attributes(
        star.sales,
        star.products,
        "product_key",
        names,
        {"total_sales": "sales_amount", "total_quantity": "quantity"},
    )
    ranked = SlicedOrder(grouped, "total_sales", names).ranked(
        "revenue_rank", total="overall_total_sales"
    )
    return ranked.select(
        *names,
        "total_sales",
        "total_quantity",
        "overall_total_sales",
        percent(F.col("total_sales"), F.col("overall_total_sales")).alias("sales_percentage"),
        "revenue_rank",
    ).orderBy(*desc("total_sales"), *asc(*names))
