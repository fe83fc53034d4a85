"""The two wide reports, one row per customer and one row per product."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starledger.functions import segments
from starledger.functions.segments import Thresholds
from starledger.functions.semantics import (
    as_of_date,
    asc,
    desc,
    full_name,
    int_avg,
    months_between,
    percent,
    ratio2,
    years_between,
)
from starledger.operators.distinct import aggregate_distinct_apart
from starledger.operators.means import mean_quotient
from starledger.operators.members import additive_by_member, describe_member, resolve_member
from starledger.operators.ranking import SlicedOrder, rank_values, top_n
from starledger.star import Star, dated_sales

# --- fixed values: report columns, in order -----------------------------------

CUSTOMER_COLUMNS = """
    customer_key customer_number first_name last_name full_name
    age age_group gender country birthdate
    customer_segment engagement_status value_tier purchase_frequency_segment
    first_order_date last_order_date recency_months recency_days lifespan_months
    total_orders total_products total_quantity
    customer_lifetime_value avg_transaction_value
    avg_order_value avg_monthly_spend avg_orders_per_month avg_items_per_order
    product_diversity_score
    highest_price_paid lowest_price_paid avg_price_paid
    customer_health_score
    revenue_rank order_frequency_rank country_revenue_rank
    revenue_decile revenue_quartile
""".split()

PRODUCT_COLUMNS = """
    product_key product_name category subcategory
    product_cost cost_range
    first_sale_date last_sale_date recency_months lifespan_months
    performance_segment recency_status
    total_orders total_customers total_quantity
    total_sales sales_percentage avg_transaction_value
    avg_order_revenue avg_monthly_revenue avg_orders_per_customer
    avg_selling_price min_selling_price max_selling_price
    avg_profit_margin profit_margin_pct
    product_health_score
    category_revenue_rank overall_revenue_rank
""".split()


# --- customers ----------------------------------------------------------------


def customer_metrics(star: Star, diversity: bool = True) -> DataFrame:
    """Measures and attributes per customer, from dated sales only; those of
    unknown customers make one nameless row.

    Distinct products take a pass of their own over the facts, which
    ``diversity=False`` leaves out.
    """
    distinct = {"total_orders": "order_number"}
    facts = resolve_member(dated_sales(star.sales), star.customers, "customer_key")
    if diversity:
        distinct["total_products"] = "product_key"
        measured = ["sales_amount", "quantity", "order_date", "price"]
        facts = star.for_passes(facts, ["customer_key", *distinct.values(), *measured])
    metrics = aggregate_distinct_apart(
        facts,
        "customer_key",
        [
            F.sum("sales_amount").alias("customer_lifetime_value"),
            F.sum("quantity").alias("total_quantity"),
            int_avg(F.col("sales_amount")).alias("avg_transaction_value"),
            F.min("order_date").alias("first_order_date"),
            F.max("order_date").alias("last_order_date"),
            F.max("price").alias("highest_price_paid"),
            F.min("price").alias("lowest_price_paid"),
            int_avg(F.col("price")).alias("avg_price_paid"),
        ],
        distinct,
    )
    return describe_member(
        metrics,
        star.customers,
        "customer_key",
        ["customer_number", "first_name", "last_name", "country", "gender", "birthdate"],
    )


def with_customer_figures(
    metrics: DataFrame, as_of: date | None = None, limits: Thresholds = Thresholds()
) -> DataFrame:
    """Ages, spans, ratios and labels, each row by itself."""
    today = as_of_date(as_of)
    sales, orders = F.col("customer_lifetime_value"), F.col("total_orders")
    lifespan, recency = F.col("lifespan_months"), F.col("recency_months")
    last_order = F.col("last_order_date")
    figures = {
        "age_group": segments.age_group(F.col("age")),
        "customer_segment": segments.lifecycle_segment(lifespan, sales, limits),
        "engagement_status": segments.engagement_status(recency),
        "value_tier": segments.value_tier(sales),
        "purchase_frequency_segment": segments.purchase_frequency(orders),
        "avg_order_value": ratio2(sales, orders),
        "avg_monthly_spend": ratio2(sales, lifespan),
        "avg_orders_per_month": ratio2(orders, lifespan),
        "avg_items_per_order": ratio2(F.col("total_quantity"), orders),
        "customer_health_score": segments.customer_health(sales, recency, orders),
    }
    if "total_products" in metrics.columns:
        figures["product_diversity_score"] = ratio2(F.col("total_products"), orders)
    return metrics.withColumns(
        {
            "full_name": full_name(F.col("first_name"), F.col("last_name")),
            "age": years_between(F.col("birthdate"), today),
            "lifespan_months": months_between(F.col("first_order_date"), last_order),
            "recency_months": months_between(last_order, today),
            "recency_days": F.datediff(today, last_order),
        }
    ).withColumns(figures)


def report_customers(
    star: Star, as_of: date | None = None, limits: Thresholds = Thresholds()
) -> DataFrame:
    """All 38 columns.

    The metrics are computed and staged on call (see :class:`SlicedOrder`);
    figures and labels are added when the report is read.
    """
    ranked = SlicedOrder(
        customer_metrics(star),
        "customer_lifetime_value",
        tie_break=["customer_key"],
        within="country",
    ).ranked(
        "revenue_rank",
        within_rank="country_revenue_rank",
        ntiles={"revenue_decile": 10, "revenue_quartile": 4},
    )
    ranked = rank_values(ranked, "total_orders", "order_frequency_rank")
    return with_customer_figures(ranked, as_of, limits).select(*CUSTOMER_COLUMNS)


def customers_by_value(
    star: Star, as_of: date | None = None, limits: Thresholds = Thresholds()
) -> DataFrame:
    return report_customers(star, as_of, limits).orderBy(
        *desc("customer_lifetime_value"), *asc("customer_key")
    )


def at_risk_high_value(star: Star, as_of: date | None = None) -> DataFrame:
    """A filter on the customer report that needs none of its ranks, so it stages nothing."""
    customers = with_customer_figures(customer_metrics(star, diversity=False), as_of)
    return customers.where(
        (F.col("engagement_status") == "At Risk") & (F.col("value_tier") == "High Value")
    ).select("full_name", "customer_lifetime_value", "recency_months")


# --- products -----------------------------------------------------------------


def product_metrics(star: Star) -> DataFrame:
    """Measures and attributes per product. Undated sales count; a product with no
    other sales has no dates."""
    distinct = {"total_orders": "order_number", "total_customers": "customer_key"}
    measured = ["sales_amount", "quantity", "order_date", "price"]
    facts = star.for_passes(
        resolve_member(star.sales, star.products, "product_key"), ["product_key", *distinct.values(), *measured]
    )
    metrics = aggregate_distinct_apart(
        facts,
        "product_key",
        [
            F.sum("sales_amount").alias("total_sales"),
            int_avg(F.col("sales_amount")).alias("avg_transaction_value"),
            F.sum("quantity").alias("total_quantity"),
            F.min("order_date").alias("first_sale_date"),
            F.max("order_date").alias("last_sale_date"),
            F.min("price").alias("min_selling_price"),
            F.max("price").alias("max_selling_price"),
        ],
        distinct,
    )
    prices = mean_quotient(facts, "product_key", "sales_amount", "quantity", "_price").select(
        F.col("product_key").alias("_priced"), F.round("_price", 2).alias("avg_selling_price")
    )
    priced = metrics.join(prices, F.col("product_key").eqNullSafe(F.col("_priced")), "left").drop("_priced")
    return describe_member(
        priced, star.products, "product_key", ["product_name", "category", "subcategory", "cost"]
    ).withColumnRenamed("cost", "product_cost")


def with_product_figures(
    metrics: DataFrame, as_of: date | None = None, limits: Thresholds = Thresholds()
) -> DataFrame:
    """Spans, ratios, margins and labels, each row by itself."""
    today = as_of_date(as_of)
    sales, orders, cost = F.col("total_sales"), F.col("total_orders"), F.col("product_cost")
    last_sale, recency = F.col("last_sale_date"), F.col("recency_months")
    margin = F.col("avg_selling_price") - cost
    return metrics.withColumns(
        {
            "lifespan_months": months_between(F.col("first_sale_date"), last_sale),
            "recency_months": months_between(last_sale, today),
        }
    ).withColumns(
        {
            "cost_range": segments.report_cost_range(cost),
            "performance_segment": segments.performance_segment(sales, limits),
            "recency_status": segments.recency_status(recency),
            "avg_order_revenue": ratio2(sales, orders),
            "avg_monthly_revenue": ratio2(sales, F.col("lifespan_months")),
            "avg_orders_per_customer": ratio2(orders, F.col("total_customers")),
            "avg_profit_margin": F.round(margin, 2),
            "profit_margin_pct": percent(margin, cost),
            "product_health_score": segments.product_health(sales, recency, limits),
        }
    )


def report_products(
    star: Star, as_of: date | None = None, limits: Thresholds = Thresholds()
) -> DataFrame:
    """All 29 columns, staged on call like the customer report."""
    ranked = SlicedOrder(
        product_metrics(star), "total_sales", tie_break=["product_key"], within="category"
    ).ranked("overall_revenue_rank", total="all_sales", within_rank="category_revenue_rank")
    shared = ranked.withColumn(
        "sales_percentage", percent(F.col("total_sales"), F.col("all_sales"))
    )
    return with_product_figures(shared, as_of, limits).select(*PRODUCT_COLUMNS)


def products_by_sales(
    star: Star, as_of: date | None = None, limits: Thresholds = Thresholds()
) -> DataFrame:
    return report_products(star, as_of, limits).orderBy(*desc("total_sales"), *asc("product_key"))


def best_selling_products(star: Star, n: int = 10) -> DataFrame:
    """Three columns of the product report, without computing the rest of it."""
    per_product = additive_by_member(
        star.sales, star.products, "product_key", {"total_sales": "sales_amount"}
    )
    best = top_n(per_product, n, *desc("total_sales"), *asc("product_key"))
    return (
        describe_member(best, star.products, "product_key", ["product_name", "category"])
        .orderBy(*desc("total_sales"), *asc("product_key"))
        .select("product_name", "category", "total_sales")
    )


# --- views --------------------------------------------------------------------


def create_views(star: Star, as_of: date | None = None, limits: Thresholds = Thresholds()) -> None:
    """Temporary views over the star and both reports, for SQL users.

    The report views show the state at the time of this call.
    """
    for name, table in star.tables().items():
        table.createOrReplaceTempView(name)
    report_customers(star, as_of, limits).createOrReplaceTempView("report_customers")
    report_products(star, as_of, limits).createOrReplaceTempView("report_products")


def refresh_report_tables(
    star: Star, schema: str = "gold", as_of: date | None = None, limits: Thresholds = Thresholds()
) -> None:
    """Write both reports as tables of ``schema``, in place of those that are there.

    The tables show the state at the time of the call: call it again after a load, or when
    the day changes.
    """
    spark = star.sales.sparkSession
    spark.sql(f"CREATE SCHEMA IF NOT EXISTS {schema}")
    for name, report in (("report_customers", report_customers), ("report_products", report_products)):
        table = report(star, as_of, limits)
        table.write.mode("overwrite").format("parquet").saveAsTable(f"{schema}.{name}")
