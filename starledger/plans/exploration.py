"""Exploration: metadata, dimensions, key figures, distributions and rankings."""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starledger.functions.semantics import (
    as_of_date,
    asc,
    dense_rank_desc,
    desc,
    int_avg,
    int_div,
    months_between,
    percent,
    subject_name,
    years_between,
)
from starledger.operators.distinct import aggregate_distinct_apart, count_distinct_of_best
from starledger.operators.members import additive_by_attributes, describe_member, resolve_member
from starledger.operators.ranking import top_n, top_ranked
from starledger.operators.totals import over_groups, over_members, with_total_row
from starledger.star import Star

CUSTOMER_NAMES = ["first_name", "last_name"]
PRODUCT_NAMES = ["product_name", "category", "subcategory"]
TOTAL = "Total"


# --- metadata -----------------------------------------------------------------


def schema_profile(tables: dict[str, DataFrame], approx_distinct: bool = False) -> DataFrame:
    """One row per column: type, rows and NULLs, with the table's column count.

    Each table is aggregated once, whatever its number of columns.
    """
    return reduce(
        DataFrame.unionByName,
        [_profile(name, df, approx_distinct) for name, df in tables.items()],
    )


def _profile(name: str, df: DataFrame, approx_distinct: bool) -> DataFrame:
    def facts(position: int, column: str, data_type: str):
        found = F.count(column)
        fields = [
            F.lit(position).alias("ordinal_position"),
            F.lit(column).alias("column_name"),
            F.lit(data_type).alias("data_type"),
            F.count(F.lit(1)).alias("row_count"),
            (F.count(F.lit(1)) - found).alias("null_count"),
        ]
        if approx_distinct:
            fields.append(F.approx_count_distinct(column).alias("approx_distinct"))
        return F.struct(*fields)

    columns = [facts(i, c, t) for i, (c, t) in enumerate(df.dtypes, start=1)]
    return df.agg(F.inline(F.array(*columns))).select(
        subject_name(F.lit(name)).alias("table_name"),
        F.lit(len(columns)).alias("number_of_columns"),
        "*",
    )


# --- dimensions ---------------------------------------------------------------


def countries(star: Star) -> DataFrame:
    return star.customers.select("country").distinct().orderBy(*asc("country"))


def product_catalog(star: Star) -> DataFrame:
    return star.products.select("product_id", *PRODUCT_NAMES).orderBy(
        *asc("category", "subcategory", "product_name", "product_id")
    )


def hierarchy_depth(star: Star) -> DataFrame:
    return (
        star.products.groupBy("category")
        .agg(
            F.count_distinct("subcategory").alias("number_of_subcategories"),
            F.count("product_key").alias("number_of_products"),
        )
        .orderBy(*desc("number_of_subcategories", "number_of_products"), *asc("category"))
    )


# --- time span ----------------------------------------------------------------


def sales_preview(star: Star, n: int = 100, order_by: list[str] | None = None) -> DataFrame:
    """Any ``n`` sales, read from as few files as that takes; the first ``n`` in
    a given order when the choice must be repeatable."""
    return star.sales.limit(n) if order_by is None else top_n(star.sales, n, *asc(*order_by))


def business_timeframe(star: Star) -> DataFrame:
    first, last = F.col("start_date"), F.col("end_date")
    span = star.sales.agg(F.min("order_date").alias("start_date"), F.max("order_date").alias("end_date"))
    return span.select(
        first,
        last,
        months_between(first, last).alias("duration_in_months"),
        years_between(first, last).alias("duration_in_years"),
    )


def customer_ages(star: Star, as_of: date | None = None) -> DataFrame:
    """Age range. ``youngest_birthdate`` is the earliest birthdate, as its name
    is defined by the report this reproduces."""
    aged = star.customers.select(
        "birthdate", years_between(F.col("birthdate"), as_of_date(as_of)).alias("age")
    )
    return aged.agg(
        F.min("age").alias("youngest_age"),
        F.max("age").alias("oldest_age"),
        int_avg(F.col("age")).alias("average_age"),
        F.min("birthdate").alias("youngest_birthdate"),
        F.max("birthdate").alias("oldest_birthdate"),
    )


# --- key figures --------------------------------------------------------------


def kpi_dashboard(star: Star) -> DataFrame:
    """Ten measures, one row each."""
    sales, items, orders, buyers = (
        F.col(c) for c in ("total_sales", "total_items", "total_orders", "buyers")
    )
    products, customers = F.col("total_products"), F.col("total_customers")
    figures = aggregate_distinct_apart(
        star.sales,
        None,
        [
            F.sum("sales_amount").alias("total_sales"),
            F.sum("quantity").alias("total_items"),
            int_avg(F.col("price")).alias("average_price"),
        ],
        distinct={"total_orders": "order_number", "buyers": "customer_key"},
    ).select(
        "*",
        star.products.agg(F.count("product_key")).scalar().alias("total_products"),
        star.customers.agg(F.count("customer_key")).scalar().alias("total_customers"),
    )
    measures = {
        "Total Sales": sales,
        "Items Sold": items,
        "Average Price": F.col("average_price"),
        "Total Orders": orders,
        "Total Products": products,
        "Total Customers": customers,
        "Customers With Orders": buyers,
        "Customer Engagement Rate (%)": percent(buyers, customers),
        "Average Order Value": int_div(sales, orders),
        "Revenue Per Customer": int_div(sales, buyers),
    }
    rows = [
        F.struct(F.lit(name).alias("measure_name"), value.cast("double").alias("measure_value"))
        for name, value in measures.items()
    ]
    return figures.select(F.inline(F.array(*rows)))


# --- distributions ------------------------------------------------------------


def _member_counts(dimension: DataFrame, by: str, key: str, counted: str) -> DataFrame:
    return dimension.groupBy(by).agg(F.count(key).alias(counted))


def _with_share(grouped: DataFrame, counted: str) -> DataFrame:
    return grouped.withColumn("percentage", percent(F.col(counted), over_groups(counted)))


def _distribution_with_total(dimension: DataFrame, by: str, key: str, counted: str) -> DataFrame:
    grouped = _member_counts(dimension, by, key, counted)
    total = grouped.agg(F.sum(counted).alias(counted)).select(
        F.lit(TOTAL).alias(by), counted, F.lit(100.0).alias("percentage")
    )
    return with_total_row(_with_share(grouped, counted), total, counted)


def country_distribution(star: Star) -> DataFrame:
    counts = _member_counts(star.customers, "country", "customer_key", "total_customers")
    return _with_share(counts, "total_customers").orderBy(*desc("total_customers"), *asc("country"))


def gender_distribution(star: Star) -> DataFrame:
    return _distribution_with_total(star.customers, "gender", "customer_key", "total_customers")


def category_distribution(star: Star) -> DataFrame:
    return _distribution_with_total(star.products, "category", "product_key", "total_products")


def cost_by_category(star: Star) -> DataFrame:
    """Cost range per category. The overall row averages the category averages."""
    grouped = star.products.groupBy("category").agg(
        int_avg(F.col("cost")).alias("avg_cost"),
        F.min("cost").alias("min_cost"),
        F.max("cost").alias("max_cost"),
    )
    overall = grouped.agg(
        int_avg(F.col("avg_cost")).alias("avg_cost"),
        F.min("min_cost").alias("min_cost"),
        F.max("max_cost").alias("max_cost"),
    ).withColumn("category", F.lit("Overall Average"))
    return with_total_row(grouped, overall, "avg_cost")


def sales_by_category(star: Star) -> DataFrame:
    """Sales and orders per category. An order that spans categories counts in each,
    and the total row adds those counts up."""
    grouped = (
        star.products.select("product_key", "category")
        .join(star.sales, "product_key", "right")
        .groupBy("category")
        .agg(
            F.sum("sales_amount").alias("total_sales"),
            F.count_distinct("order_number").alias("total_orders"),
        )
    )
    detail = grouped.select(
        "*",
        percent(F.col("total_sales"), over_groups("total_sales")).alias("sales_percentage"),
        # One row per category of the product hierarchy.
        dense_rank_desc("total_sales").alias("revenue_rank"),
    )
    total = grouped.agg(
        F.sum("total_sales").alias("total_sales"), F.sum("total_orders").alias("total_orders")
    ).select(F.lit(TOTAL).alias("category"), "*", F.lit(100.0).alias("sales_percentage"))
    return with_total_row(detail, total, "total_sales")


def items_by_country(star: Star) -> DataFrame:
    measures = ["total_items_sold", "total_sales"]
    grouped = additive_by_attributes(
        star.sales,
        star.customers,
        "customer_key",
        ["country"],
        {"total_items_sold": "quantity", "total_sales": "sales_amount"},
    )
    detail = grouped.select(
        "*",
        percent(F.col("total_items_sold"), over_groups("total_items_sold")).alias("items_percentage"),
        percent(F.col("total_sales"), over_groups("total_sales")).alias("sales_percentage"),
    )
    total = grouped.agg(*[F.sum(m).alias(m) for m in measures]).select(
        F.lit(TOTAL).alias("country"),
        "*",
        F.lit(100.0).alias("items_percentage"),
        F.lit(100.0).alias("sales_percentage"),
    )
    return with_total_row(detail, total, "total_items_sold")


# --- customer rankings --------------------------------------------------------


def clv_summary(star: Star) -> DataFrame:
    """Lifetime value over every customer key found in the sales.

    Customer attributes do not enter the figures and keys are unique in the
    dimension, so the dimension is not read.
    """
    per_customer = star.sales.groupBy("customer_key").agg(
        F.sum("sales_amount").alias("total_sales"),
        F.count_distinct("order_number").alias("total_orders"),
        int_avg(F.col("sales_amount")).alias("avg_transaction_value"),
    )
    return per_customer.agg(
        F.count("customer_key").alias("total_customers"),
        int_avg(F.col("total_sales")).alias("avg_customer_ltv"),
        F.min("total_sales").alias("min_customer_ltv"),
        F.max("total_sales").alias("max_customer_ltv"),
        int_avg(F.col("total_orders")).alias("avg_orders_per_customer"),
        int_avg(F.col("avg_transaction_value")).alias("avg_transaction_value"),
    )


def _per_customer(star: Star) -> DataFrame:
    return (
        resolve_member(star.sales, star.customers, "customer_key")
        .groupBy("customer_key")
        .agg(
            F.sum("sales_amount").alias("total_sales"),
            F.count_distinct("order_number").alias("total_orders"),
            int_avg(F.col("sales_amount")).alias("avg_transaction_value"),
        )
    )


def _named(best: DataFrame, star: Star) -> DataFrame:
    """Names for a handful of ranked customers, looked up after the ranking."""
    return describe_member(best, star.customers, "customer_key", CUSTOMER_NAMES)


def top_customers(star: Star, n: int = 10) -> DataFrame:
    """Ranked by sums first; orders are counted for the winners only."""
    order = [*desc("total_sales"), *asc("customer_key")]
    by_key = star.sales.groupBy(F.col("customer_key").alias("sold_key")).agg(
        F.sum("sales_amount").alias("sales"), F.count("sales_amount").alias("amounts")
    )
    keyed = resolve_member(
        by_key.withColumn("customer_key", F.col("sold_key")), star.customers, "customer_key"
    )
    totals = keyed.groupBy("customer_key").agg(
        F.sum("sales").alias("total_sales"),
        int_div(F.sum("sales"), F.sum("amounts")).alias("avg_transaction_value"),
    )
    best = count_distinct_of_best(
        top_n(totals, n, *order),
        keyed,
        star.sales.withColumnRenamed("customer_key", "sold_key"),
        "sold_key",
        ["customer_key"],
        "order_number",
        "total_orders",
    )
    named = _named(best, star)
    return named.select(
        "customer_key", *CUSTOMER_NAMES, "total_sales", "total_orders", "avg_transaction_value"
    ).orderBy(*order)


def least_frequent_customers(star: Star, n: int = 10) -> DataFrame:
    order = asc("total_orders", "total_sales", "customer_key")
    named = _named(top_n(_per_customer(star).drop("avg_transaction_value"), n, *order), star)
    return named.select("customer_key", *CUSTOMER_NAMES, "total_orders", "total_sales").orderBy(*order)


# --- product rankings ---------------------------------------------------------


def top_products(star: Star, n: int = 10) -> DataFrame:
    """Products by name, ranked by sums first; orders are counted for the winners only."""
    order = [*desc("total_sales"), *asc(*PRODUCT_NAMES)]
    by_key = star.sales.groupBy("product_key").agg(
        F.sum("sales_amount").alias("sales"), F.sum("quantity").alias("quantity")
    )
    keyed = by_key.join(star.products.select("product_key", *PRODUCT_NAMES), "product_key", "left")
    totals = keyed.groupBy(*PRODUCT_NAMES).agg(
        F.sum("sales").alias("total_sales"), F.sum("quantity").alias("total_quantity_sold")
    )
    best = count_distinct_of_best(
        top_n(totals, n, *order),
        keyed,
        star.sales,
        "product_key",
        PRODUCT_NAMES,
        "order_number",
        "total_orders",
    )
    return best.orderBy(*order)


def top_products_ranked(star: Star, ranks: int = 10) -> DataFrame:
    """Products holding one of the largest ``ranks`` totals, with ties; the share
    is of all sales."""
    per_product = additive_by_attributes(
        star.sales,
        star.products,
        "product_key",
        ["product_name", "category"],
        {"total_sales": "sales_amount"},
    )
    all_sales = over_members(per_product, "total_sales")
    return top_ranked(per_product, "total_sales", ranks, "revenue_rank").select(
        "product_name",
        "category",
        "total_sales",
        percent(F.col("total_sales"), all_sales).alias("sales_percentage"),
        "revenue_rank",
    )


def bottom_products(star: Star, n: int = 10) -> DataFrame:
    """Lowest sales among products that have any."""
    per_product = additive_by_attributes(
        star.sales,
        star.products,
        "product_key",
        PRODUCT_NAMES,
        {"total_sales": "sales_amount", "total_quantity_sold": "quantity"},
    )
    return top_n(per_product, n, *asc("total_sales", *PRODUCT_NAMES))


def _per_subcategory(star: Star) -> DataFrame:
    """Sales per subcategory. With one row per product key before the last step,
    counting keys is counting distinct products."""
    by_key = star.sales.groupBy("product_key").agg(F.sum("sales_amount").alias("total_sales"))
    known = star.products.select(
        F.col("product_key").alias("known_key"), "product_key", "subcategory", "category"
    )
    return (
        by_key.join(known, "product_key", "left")
        .groupBy("subcategory", "category")
        .agg(
            F.sum("total_sales").alias("total_sales"),
            F.count("known_key").alias("number_of_products"),
        )
    )


def top_subcategories(star: Star, n: int = 10) -> DataFrame:
    grouped = _per_subcategory(star)
    shared = grouped.withColumn(
        "sales_percentage", percent(F.col("total_sales"), over_members(grouped, "total_sales"))
    )
    return top_n(shared, n, *desc("total_sales"), *asc("subcategory", "category"))


def bottom_subcategories(star: Star, n: int = 10) -> DataFrame:
    return top_n(_per_subcategory(star), n, *asc("total_sales", "subcategory", "category"))
