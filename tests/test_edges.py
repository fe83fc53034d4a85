"""Hand-written stars with the awkward rows."""

from datetime import date

import pytest

from starledger.functions.segments import Thresholds
from starledger.plans import contribution, exploration, reports, segmentation, trends
from tests.conftest import sale

AS_OF = date(2014, 3, 1)

CUSTOMERS = [
    {"customer_key": 1, "first_name": "Ann", "last_name": "Lee", "country": "X", "birthdate": date(1990, 12, 31)},
    {"customer_key": 2, "last_name": "Poe", "country": "X"},
    {"customer_key": 3, "first_name": "Never", "country": "Y"},
]
PRODUCTS = [
    {"product_key": 1, "product_name": "bike", "category": "B", "subcategory": "b1", "cost": 0},
    {"product_key": 2, "product_name": "bell", "category": "B", "subcategory": "b2", "cost": 50},
    {"product_key": 3, "product_name": "pedal", "cost": None},
    {"product_key": 4, "product_name": "unsold", "category": "C", "subcategory": "c1", "cost": 1000},
]
SALES = [
    sale("o1", 1, 1, "2013-01-31", 100, quantity=2, price=50),
    sale("o1", 1, 2, "2013-01-31", 10),
    sale("o2", 1, 1, "2014-02-01", 60, quantity=0),
    sale("o3", 2, 3, None, 33),
    sale("o4", 99, 1, "2013-12-31", 5),
    sale("o5", None, 77, "2014-01-01", 7),
    sale("o5", 98, None, "2014-01-01", 8),
]


@pytest.fixture
def star(make_star):
    return make_star(CUSTOMERS, PRODUCTS, SALES)


def by(df, key):
    return {r[key]: r for r in df.collect()}


def test_customer_report(star):
    rows = by(reports.report_customers(star, AS_OF), "customer_key")
    assert set(rows) == {1, None}  # undated sales only: not in the report
    ann, nobody = rows[1], rows[None]
    assert (ann.total_orders, ann.total_products, ann.customer_lifetime_value) == (2, 2, 170)
    assert (ann.age, ann.lifespan_months, ann.recency_months, ann.recency_days) == (24, 13, 1, 28)
    assert (ann.avg_transaction_value, ann.avg_order_value, ann.avg_monthly_spend) == (56, 85.0, 13.08)
    assert (nobody.full_name, nobody.age_group, nobody.country) == (" ", "50+", None)
    assert (nobody.total_orders, nobody.total_products, nobody.customer_lifetime_value) == (2, 2, 20)
    assert nobody.lifespan_months == 1
    assert (ann.revenue_rank, nobody.revenue_rank) == (1, 2)
    assert (ann.order_frequency_rank, nobody.order_frequency_rank) == (1, 1)
    assert (ann.country_revenue_rank, nobody.country_revenue_rank) == (1, 1)
    # Two rows in ten and in four tiles.
    assert (ann.revenue_decile, nobody.revenue_decile) == (1, 2)
    assert (ann.revenue_quartile, nobody.revenue_quartile) == (1, 2)
    assert len(reports.CUSTOMER_COLUMNS) == 38


def test_no_lifespan_no_monthly_figures(make_star):
    star = make_star(CUSTOMERS, PRODUCTS, [sale("o", 1, 1, "2014-01-05", 10), sale("p", 1, 1, "2014-01-31", 10)])
    row = reports.report_customers(star, AS_OF).head()
    assert (row.lifespan_months, row.avg_monthly_spend, row.avg_orders_per_month) == (0, None, None)


def test_product_report(star):
    limits = Thresholds(product_mid_sales=20, product_high_sales=100)
    rows = by(reports.report_products(star, AS_OF, limits), "product_key")
    assert set(rows) == {1, 2, 3, None}
    bike, bell, pedal, unknown = (rows[k] for k in (1, 2, 3, None))
    # Zero quantity takes no part in the unit price: (100/2 + 5/1) / 2.
    assert (bike.avg_selling_price, bike.avg_profit_margin, bike.profit_margin_pct) == (27.5, 27.5, None)
    assert (bell.avg_profit_margin, bell.profit_margin_pct) == (-40.0, -80.0)
    assert (bike.performance_segment, bell.performance_segment) == ("High Performance", "Low Performance")
    assert (pedal.first_sale_date, pedal.recency_months, pedal.recency_status) == (None, None, "Inactive")
    assert (pedal.cost_range, pedal.product_health_score) == ("Above 1000", "Fair")
    assert (unknown.total_orders, unknown.total_customers, unknown.total_sales) == (1, 1, 15)
    assert (bike.total_customers, bike.total_orders) == (2, 3)
    assert sum(r.total_sales for r in rows.values()) == 223
    assert [r.overall_revenue_rank for r in (bike, pedal, unknown, bell)] == [1, 2, 3, 4]
    # Products without a category and unknown products rank together.
    assert (pedal.category_revenue_rank, unknown.category_revenue_rank) == (1, 2)
    assert abs(sum(r.sales_percentage for r in rows.values()) - 100) < 0.05
    assert len(reports.PRODUCT_COLUMNS) == 29


def test_report_sales_agree(star):
    customers = sum(r.customer_lifetime_value for r in reports.customer_metrics(star).collect())
    products = sum(r.total_sales for r in reports.product_metrics(star).collect())
    undated = 33
    assert customers + undated == products


def test_total_row_counts_an_order_once_per_category(star):
    rows = by(exploration.sales_by_category(star), "category")
    assert (rows["B"].total_orders, rows[None].total_orders) == (3, 2)
    assert (rows["Total"].total_orders, rows["Total"].total_sales) == (5, 223)
    assert rows["Total"].revenue_rank is None


def test_overall_average_is_unweighted(make_star):
    products = [
        {"product_key": i, "category": c, "cost": cost}
        for i, (c, cost) in enumerate([("A", 10), ("A", 11), ("B", 100), (None, 3)])
    ]
    rows = by(exploration.cost_by_category(make_star((), products, ())), "category")
    assert {k: r.avg_cost for k, r in rows.items()} == {"A": 10, "B": 100, None: 3, "Overall Average": 37}


def test_previous_month_is_the_previous_one_present(make_star):
    star = make_star((), (), [sale("o", 1, 1, "2013-01-31", 10), sale("p", 1, 1, "2013-06-01", 25)])
    january, june = trends.month_over_month(star).collect()
    assert (june.previous_month_sales, june.month_over_month_diff, june.month_over_month_growth_pct) == (10, 15, 100)
    assert (june.ytd_sales, june.yearly_total_customers) == (35, 2)
    assert january.previous_month_sales is None


def test_running_frames(make_star):
    days = ["2013-01-01", "2013-02-01", "2013-03-01", "2013-04-01"]
    star = make_star((), (), [sale(d, 1, 1, d, a) for d, a in zip(days, (10, 20, 31, 5))])
    rows = trends.monthly_running(star).collect()
    assert [r.running_total_sales for r in rows] == [10, 30, 61, 66]
    assert [r.rolling_3_month_avg_sales for r in rows] == [10, 15, 20, 18]
    assert [r.rolling_3_month_total for r in rows] == [30, 61, 56, 36]
    assert [r.cumulative_avg_price for r in rows] == [10, 15, 20, 16]


def test_year_over_year_labels(make_star):
    sales = [sale(f"o{y}", 1, 1, f"{y}-05-01", a) for y, a in ((2010, 10), (2011, 30), (2012, 30), (2013, 10))]
    rows = trends.product_year_over_year(make_star((), PRODUCTS, sales)).collect()
    assert [r.yoy_trend for r in rows] == ["No Change", "Growth", "No Change", "Decline"]
    assert [r.yoy_growth_pct for r in rows] == [None, 200, 0, 0]
    assert [r.performance_vs_avg for r in rows] == ["Below Average", "Above Average", "Above Average", "Below Average"]


def test_unknown_customers_weigh_but_do_not_count(star):
    rows = by(segmentation.customer_lifecycle(star, Thresholds(vip_spending=100)), "customer_segment")
    assert rows["VIP"].total_customers == 1
    # Ann is the only VIP; Poe has no dates and the unknown three make one nameless row.
    assert (rows["New"].total_customers, rows["New"].avg_spending) == (1, (33 + 20) // 2)


def test_bands_and_counts_of_products(star):
    rows = by(segmentation.cost_ranges(star), "cost_range")
    assert {k: r.total_products for k, r in rows.items()} == {"Below $100": 2, "$500-$1000": 1, "Above $1000": 1}
    ages = by(segmentation.age_groups(star, AS_OF), "age_group")
    assert ages["20-29"].total_customers == 1
    assert (ages["50+"].total_customers, ages["50+"].total_sales) == (3, 53)


def test_subcategories_count_sold_products(star):
    rows = by(exploration.top_subcategories(star), "subcategory")
    assert (rows[None].number_of_products, rows["b1"].number_of_products) == (1, 1)
    assert "c1" not in rows


def test_preview_without_order_reads_any_rows(star):
    assert exploration.sales_preview(star, 3).count() == 3
    assert exploration.sales_preview(star, 2, ["order_number"]).collect()[0].order_number == "o1"


def test_profile_with_distinct_counts(star):
    rows = exploration.schema_profile(star.tables(), approx_distinct=True).collect()
    found = {(r.table_name, r.column_name): r for r in rows}
    assert (found["Sales", "order_date"].null_count, found["Sales", "order_date"].row_count) == (1, 7)
    assert found["Products", "category"].approx_distinct == 2
    assert found["Customers", "customer_key"].number_of_columns == 10


def test_case_insensitive_texts(make_star):
    products = [{"product_key": 1, "category": "Bikes"}, {"product_key": 2, "category": "bikes"}]
    star = make_star((), products, [sale("o1", 1, 1, "2013-01-01", 5), sale("O1", 1, 2, "2013-01-01", 6)])
    assert exploration.sales_by_category(star).count() == 3
    rows = [tuple(r)[1:3] for r in exploration.sales_by_category(star.case_insensitive()).collect()]
    assert rows == [(11, 1), (11, 1)]
    ranks = [r.category_revenue_rank for r in reports.report_products(star.case_insensitive(), AS_OF).collect()]
    assert sorted(ranks) == [1, 2]


# Products per category: the shares must come out as published.
PORTFOLIO = {"Components": 127, "Bikes": 97, "Clothing": 35, "Accessories": 29, None: 7}


def test_portfolio_shares(make_star):
    categories = [c for c, n in PORTFOLIO.items() for _ in range(n)]
    products = [{"product_key": i, "category": c} for i, c in enumerate(categories)]
    rows = exploration.category_distribution(make_star((), products, ())).collect()
    assert [(r.category, r.percentage) for r in rows] == [
        ("Total", 100.0),
        ("Components", 43.05),
        ("Bikes", 32.88),
        ("Clothing", 11.86),
        ("Accessories", 9.83),
        (None, 2.37),
    ]


def test_views(spark, star):
    reports.create_views(star, AS_OF)
    best = spark.sql("SELECT product_name FROM report_products ORDER BY total_sales DESC LIMIT 1")
    assert best.head().product_name == "bike"
    assert spark.sql("SELECT count(*) AS n FROM report_customers").head().n == 2


def test_report_tables_are_refreshed(spark, star):
    """Both sample queries of the README, over tables that a refresh replaces."""
    for _ in range(2):
        reports.refresh_report_tables(star, as_of=AS_OF)
    best = spark.sql(
        "SELECT product_name, category, total_sales FROM gold.report_products"
        " ORDER BY total_sales DESC LIMIT 10"
    )
    assert best.head().product_name == "bike"
    risky = spark.sql(
        "SELECT full_name, customer_lifetime_value, recency_months FROM gold.report_customers"
        " WHERE engagement_status = 'At Risk' AND value_tier = 'High Value'"
    )
    assert risky.columns == ["full_name", "customer_lifetime_value", "recency_months"]
    assert spark.table("gold.report_customers").count() == 2
    spark.sql("DROP SCHEMA gold CASCADE")


ALL = [
    exploration.business_timeframe,
    exploration.customer_ages,
    exploration.kpi_dashboard,
    exploration.country_distribution,
    exploration.gender_distribution,
    exploration.cost_by_category,
    exploration.sales_by_category,
    exploration.clv_summary,
    exploration.top_customers,
    exploration.top_products_ranked,
    trends.month_over_month,
    trends.product_year_over_year,
    contribution.category_contribution,
    contribution.product_contribution,
    segmentation.customer_lifecycle,
    reports.report_customers,
    reports.report_products,
    reports.at_risk_high_value,
]


@pytest.mark.parametrize("job", ALL, ids=lambda j: j.__name__)
def test_empty_star(make_star, job):
    rows = job(make_star()).collect()
    assert all(r[0] is None or isinstance(r[0], str) or r[0] == 0 for r in rows)
