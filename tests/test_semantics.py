from datetime import date

import pytest
from pyspark.sql import functions as F

from starledger.functions import segments as G
from starledger.functions import semantics as S


def value(spark, column):
    return spark.range(1).select(column.alias("x")).head()["x"]


@pytest.mark.parametrize("a, b, expected", [(7, 2, 3), (-7, 2, -3), (7, -2, -3), (1, 0, None), (None, 3, None)])
def test_integer_division_truncates_toward_zero(spark, a, b, expected):
    assert value(spark, S.int_div(F.lit(a).cast("int"), F.lit(b))) == expected


def test_integer_average_truncates_and_skips_nulls(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (1, None), (2, -1), (2, -2), (3, None)], "k int, x int")
    got = df.groupBy("k").agg(S.int_avg(F.col("x")).alias("a")).collect()
    assert {r.k: r.a for r in got} == {1: 1, 2: -1, 3: None}


def test_growth_is_truncated_before_scaling(spark):
    for change, base, plain, exact in [(50, 100, 0, 50.0), (-150, 100, -100, -150.0), (1, 3, 0, 33.33), (5, 0, None, None)]:
        assert value(spark, S.growth_percent(F.lit(change), F.lit(base))) == plain
        assert value(spark, S.growth_percent(F.lit(change), F.lit(base), exact=True)) == exact


@pytest.mark.parametrize(
    "start, end, months, years",
    [
        ("2001-01-31", "2001-02-01", 1, 0),
        ("2000-12-31", "2001-01-01", 1, 1),
        ("2001-01-01", "2001-01-31", 0, 0),
        ("2001-03-01", "2000-12-31", -3, -1),
        ("1999-06-15", "2001-08-01", 26, 2),
    ],
)
def test_calendar_boundaries(spark, start, end, months, years):
    a, b = (F.lit(date.fromisoformat(d)) for d in (start, end))
    assert value(spark, S.months_between(a, b)) == months
    assert value(spark, S.years_between(a, b)) == years


def test_missing_names_count_as_empty_text(spark):
    nothing = F.lit(None).cast("string")
    assert value(spark, S.full_name(F.lit("Ann"), F.lit("Lee"))) == "Ann Lee"
    assert value(spark, S.full_name(nothing, F.lit("Lee"))) == " Lee"
    assert value(spark, S.full_name(nothing, nothing)) == " "


def test_rounding_is_half_up_on_the_decimal_text(spark):
    assert value(spark, S.ratio2(F.lit(2425), F.lit(1000))) == 2.43
    assert value(spark, S.percent(F.lit(1), F.lit(3))) == 33.33
    assert value(spark, S.percent(F.lit(1), F.lit(0))) is None


def test_subject_name(spark):
    names = {"dim_customers": "Customers", "fact_SALES": "Sales", "plain": "Plain", "a_b_c": "B_c"}
    for raw, shown in names.items():
        assert value(spark, S.subject_name(F.lit(raw))) == shown


def test_as_of_defaults_to_today(spark):
    assert value(spark, S.as_of_date(date(2001, 8, 1))) == date(2001, 8, 1)
    assert value(spark, S.as_of_date(None)) == value(spark, F.current_date())


LADDERS = [
    (G.age_group, {19: "Under 20", 20: "20-29", 29: "20-29", 30: "30-39", 39: "30-39", 40: "40-49", 49: "40-49", 50: "50+", None: "50+"}),
    (G.cost_range, {99: "Below $100", 100: "$100-$499", 499: "$100-$499", 500: "$500-$1000", 1000: "$500-$1000", 1001: "Above $1000", None: "Above $1000"}),
    (G.report_cost_range, {99: "Below 100", 100: "100-499", 1000: "500-1000", 1001: "Above 1000", None: "Above 1000"}),
    (G.engagement_status, {-1: "Active", 3: "Active", 4: "At Risk", 6: "At Risk", 7: "Dormant", 12: "Dormant", 13: "Churned", None: "Churned"}),
    (G.recency_status, {3: "Active", 4: "At Risk", 12: "Dormant", 13: "Inactive", None: "Inactive"}),
    (G.value_tier, {999: "Entry Level", 1000: "Low Value", 4999: "Low Value", 5000: "Medium Value", 9999: "Medium Value", 10000: "High Value", None: "Entry Level"}),
    (G.purchase_frequency, {1: "One-Time Buyer", 2: "Occasional Buyer", 4: "Occasional Buyer", 5: "Regular Buyer", 9: "Regular Buyer", 10: "Frequent Buyer"}),
    (lambda x: G.performance_segment(x, G.Thresholds()), {199999: "Low Performance", 200000: "Mid Range", 749999: "Mid Range", 750000: "High Performance", None: None}),
]


@pytest.mark.parametrize("ladder, expected", LADDERS, ids=lambda p: getattr(p, "__name__", ""))
def test_band_edges(spark, ladder, expected):
    df = spark.createDataFrame([(x,) for x in expected], "x int").select("x", ladder(F.col("x")).alias("label"))
    assert {r.x: r.label for r in df.collect()} == expected


def test_lifecycle_edges(spark):
    cases = {(11, 9000): "New", (12, 5000): "Regular", (12, 5001): "VIP", (None, 9000): "New", (20, None): "New"}
    df = spark.createDataFrame(list(cases), "months int, spent int").select(
        "*", G.lifecycle_segment(F.col("months"), F.col("spent"), G.Thresholds()).alias("label")
    )
    assert {(r.months, r.spent): r.label for r in df.collect()} == cases


def test_health_edges(spark):
    customers = {
        (5000, 3, 5): "Excellent",
        (5000, 3, 4): "Good",
        (5000, 4, 5): "Good",
        (2000, 6, 1): "Good",
        (2000, 7, 1): "Fair",
        (1999, 6, 1): "Fair",
        (999, 6, 1): "Fair",
        (999, 7, 1): "Poor",
        (1000, None, 1): "Fair",
        (999, None, 1): "Poor",
    }
    df = spark.createDataFrame(list(customers), "sales int, idle int, orders int").select(
        "*", G.customer_health(F.col("sales"), F.col("idle"), F.col("orders")).alias("label")
    )
    assert {(r.sales, r.idle, r.orders): r.label for r in df.collect()} == customers
    products = {
        (750000, 3): "Excellent",
        (750000, 4): "Good",
        (749999, 3): "Good",
        (200000, 6): "Good",
        (200000, 7): "Fair",
        (199999, 6): "Fair",
        (199999, 7): "Poor",
        (None, 1): "Fair",
        (None, None): "Poor",
    }
    df = spark.createDataFrame(list(products), "sales int, idle int").select(
        "*", G.product_health(F.col("sales"), F.col("idle"), G.Thresholds()).alias("label")
    )
    assert {(r.sales, r.idle): r.label for r in df.collect()} == products


def test_label_order(spark):
    df = spark.createDataFrame([("b",), (None,), ("a",), ("?",)], "l string")
    ordered = df.orderBy(G.label_order(F.col("l"), ["b", "a"]).asc_nulls_first(), "l").collect()
    assert [r.l for r in ordered] == [None, "?", "b", "a"]
