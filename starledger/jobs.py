"""Every job by name, over the star derived from order-entry tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession

from starledger.functions.segments import Thresholds
from starledger.plans import contribution, exploration, reports, segmentation, trends
from starledger.sources import load, schema
from starledger.sources.order_tables import load_star
from starledger.sources.staging import staging_path
from starledger.star import Star

# --- fixed values: parameters of the registered jobs --------------------------

AS_OF = date(2001, 8, 1)
PRODUCT_LIMITS = Thresholds(product_mid_sales=7_000, product_high_sales=9_000)

Job = Callable[[SparkSession, str], DataFrame]


def _on_star(job: Callable[..., DataFrame], **parameters) -> Job:
    return lambda spark, folder: job(load_star(spark, folder), **parameters)


def _on_lines(job: Callable[..., DataFrame], **parameters) -> Job:
    """A job that reads no customer and no order date."""
    return lambda spark, folder: job(load_star(spark, folder, with_orders=False), **parameters)


def _reload(table: str, loader: Callable[..., DataFrame]) -> Job:
    """Write a star table out as delimited text and load it back."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        source, target = staging_path(spark), staging_path(spark)
        load_star(spark, folder).tables()[table].write.option("header", True).csv(source)
        return loader(spark, source, target, long_keys=True).drop(load.ORDER_YEAR)

    return run


def _schema_profile(star: Star) -> DataFrame:
    return exploration.schema_profile(star.tables())


JOBS: dict[str, Job] = {
    "e01_schema_profile": _on_star(_schema_profile),
    "e02_countries": _on_star(exploration.countries),
    "e03_product_catalog": _on_star(exploration.product_catalog),
    "e04_hierarchy_depth": _on_star(exploration.hierarchy_depth),
    "e05_sales_preview": _on_star(exploration.sales_preview, order_by=schema.FACT_SALES.names),
    "e06_business_timeframe": _on_star(exploration.business_timeframe),
    "e07_customer_ages": _on_star(exploration.customer_ages, as_of=AS_OF),
    "e08_kpi_dashboard": _on_star(exploration.kpi_dashboard),
    "e09_country_distribution": _on_star(exploration.country_distribution),
    "e10_gender_distribution": _on_star(exploration.gender_distribution),
    "e11_category_distribution": _on_star(exploration.category_distribution),
    "e12_cost_by_category": _on_star(exploration.cost_by_category),
    "e13_sales_by_category": _on_lines(exploration.sales_by_category),
    "e14_items_by_country": _on_star(exploration.items_by_country),
    "e15_clv_summary": _on_star(exploration.clv_summary),
    "e16_top10_customers": _on_star(exploration.top_customers),
    "e17_bottom10_customers": _on_star(exploration.least_frequent_customers),
    "e18_top10_products": _on_lines(exploration.top_products),
    "e19_top10_products_ranked": _on_lines(exploration.top_products_ranked),
    "e20_bottom10_products": _on_lines(exploration.bottom_products),
    "e21_top10_subcategories": _on_lines(exploration.top_subcategories),
    "e22_bottom10_subcategories": _on_lines(exploration.bottom_subcategories),
    "a01_monthly_trend": _on_star(trends.monthly_trend),
    "a02_yearly_trend": _on_star(trends.yearly_trend),
    "a03_seasonality": _on_star(trends.seasonality),
    "a04_month_over_month": _on_star(trends.month_over_month),
    "a04x_month_over_month_exact": _on_star(trends.month_over_month, exact=True),
    "a05_monthly_running": _on_star(trends.monthly_running),
    "a06_yearly_running": _on_star(trends.yearly_running),
    "a07_product_yoy": _on_star(trends.product_year_over_year),
    "a07x_product_yoy_exact": _on_star(trends.product_year_over_year, exact=True),
    "a08_category_contribution": _on_lines(contribution.category_contribution),
    "a09_subcategory_contribution": _on_lines(contribution.subcategory_contribution),
    "a10_product_contribution": _on_lines(contribution.product_contribution),
    "a11_age_groups": _on_star(segmentation.age_groups, as_of=AS_OF),
    "a12_cost_ranges": _on_star(segmentation.cost_ranges),
    "a13_product_performance": _on_lines(segmentation.product_performance, limits=PRODUCT_LIMITS),
    "a13d_product_performance_defaults": _on_lines(segmentation.product_performance),
    "a14_customer_lifecycle": _on_star(segmentation.customer_lifecycle),
    "r01_report_customers": _on_star(reports.report_customers, as_of=AS_OF),
    "r02_report_products": _on_star(reports.report_products, as_of=AS_OF, limits=PRODUCT_LIMITS),
    "r02d_report_products_defaults": _on_star(reports.report_products, as_of=AS_OF),
    "r03_products_by_sales": _on_star(
        reports.products_by_sales, as_of=AS_OF, limits=PRODUCT_LIMITS
    ),
    "r04_customers_by_clv": _on_star(reports.customers_by_value, as_of=AS_OF),
    "r05_top10_report_products": _on_lines(reports.best_selling_products),
    "r06_at_risk_high_value": _on_star(reports.at_risk_high_value, as_of=AS_OF),
    "l01_load_customers": _reload("dim_customers", load.load_customers),
    "l02_load_products": _reload("dim_products", load.load_products),
    "l03_load_sales": _reload("fact_sales", load.load_sales),
}
