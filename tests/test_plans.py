"""Shapes of the executed plans, with every join shuffled as it would be at scale."""

import re
from types import SimpleNamespace

import pytest

from starledger import star
from starledger.jobs import JOBS
from starledger.operators import ranking
from starledger.plans import reports
from starledger.sources import staging
from starledger.sources.order_tables import load_star
from starledger.sources.staging import staging_root
from tests.conftest import SMALL


@pytest.fixture(autouse=True)
def shuffled_joins(settings):
    settings(
        spark__sql__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__autoBroadcastJoinThreshold="-1",
    )


def executed(df) -> list[str]:
    """Lines of the plan as it ran, subqueries included, initial plans left out."""
    df.collect()
    lines, skip_from = [], None
    for line in df._jdf.queryExecution().executedPlan().toString().splitlines():
        indent = re.search(r"[A-Za-z=(*]", line)
        column = indent.start() if indent else 0
        if skip_from is not None and column >= skip_from:
            continue
        skip_from = column if "== Initial Plan ==" in line else None
        if skip_from is None:
            lines.append(line)
    return lines


def scans(lines, table):
    return [x for x in lines if "FileScan" in x and f"/{table}.parquet" in x]


ONE_PASS = [
    "e13_sales_by_category",
    "e14_items_by_country",
    "e15_clv_summary",
    "e19_top10_products_ranked",
    "e21_top10_subcategories",
    "a01_monthly_trend",
    "a04_month_over_month",
    "a07_product_yoy",
    "a08_category_contribution",
    "a11_age_groups",
    "a13_product_performance",
    "a14_customer_lifecycle",
    "r05_top10_report_products",
    "r06_at_risk_high_value",
]


@pytest.mark.parametrize("name", ONE_PASS)
def test_facts_are_read_once(spark, name):
    """Total rows and rank filters reuse an exchange of folded facts, never one of
    plain facts, over which joins and aggregations would run again."""
    lines = executed(JOBS[name](spark, SMALL))
    assert len(scans(lines, "lineitem")) == 1, "\n".join(lines)
    reused = [x for x in lines if "ReusedExchange" in x]
    assert not [x for x in reused if "sales_amount#" in x or "l_orderkey#" in x], "\n".join(lines)


@pytest.mark.parametrize(
    "name",
    [
        "r01_report_customers",
        "r02_report_products",
        "r03_products_by_sales",
        "r04_customers_by_clv",
    ],
)
def test_facts_with_several_counts_are_joined_once(spark, monkeypatch, name):
    """One plan of the job joins lines and orders; it writes what the counts read."""
    plans, written = [], staging.stage

    def recorded(df):
        plans.append(executed(df))
        return written(df)

    for module in (star, ranking):
        monkeypatch.setattr(module, "stage", recorded)
    plans.append(executed(JOBS[name](spark, SMALL)))
    assert [len(scans(p, "lineitem")) for p in plans].count(1) == 1
    assert sum(len(scans(p, t)) for p in plans for t in ("lineitem", "orders")) == 2
    narrow = next(p for p in plans if scans(p, "lineitem"))
    assert "l_shipdate" not in read_columns(scans(narrow, "lineitem")[0])


def test_stored_facts_are_not_written_again(spark, monkeypatch):
    monkeypatch.setattr(star, "stage", None)
    stored = load_star(spark, SMALL)
    reports.customer_metrics(star.Star(stored.customers, stored.products, stored.sales)).collect()


@pytest.mark.parametrize("name", ["e12_cost_by_category", "a12_cost_ranges", "e11_category_distribution"])
def test_dimension_is_read_once(spark, name):
    assert len(scans(executed(JOBS[name](spark, SMALL)), "part")) == 1


@pytest.mark.parametrize("name", JOBS)
def test_no_pairing_joins_no_python_no_copies_of_facts(spark, name):
    plan = "\n".join(executed(JOBS[name](spark, SMALL)))
    for unwanted in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "Expand"):
        assert unwanted not in plan, plan


def read_columns(line):
    return set(re.findall(r"(\w+):", line.split("ReadSchema: struct<")[1]))


def test_scans_read_needed_columns_only(spark):
    lines = executed(JOBS["r05_top10_report_products"](spark, SMALL))
    assert read_columns(scans(lines, "lineitem")[0]) <= {"l_partkey", "l_extendedprice"}
    lines = executed(JOBS["e06_business_timeframe"](spark, SMALL))
    assert read_columns(scans(lines, "lineitem")[0]) == {"l_orderkey"}
    assert read_columns(scans(lines, "orders")[0]) <= {"o_orderkey", "o_orderdate"}


def test_product_jobs_do_not_touch_orders(spark):
    for name in ("e13_sales_by_category", "a09_subcategory_contribution", "r05_top10_report_products"):
        assert scans(executed(JOBS[name](spark, SMALL)), "orders") == []


def test_top_n_is_not_a_full_sort(spark):
    for name in ("e17_bottom10_customers", "e20_bottom10_products", "e22_bottom10_subcategories"):
        assert any("TakeOrderedAndProject" in x for x in executed(JOBS[name](spark, SMALL)))


def test_reports_rank_from_the_staged_table(spark):
    """After staging, the report reads its slices and no fact."""
    for name in ("r01_report_customers", "r02_report_products", "a10_product_contribution"):
        report = JOBS[name](spark, SMALL)
        assert scans(executed(report), "lineitem") == []
        read = report.inputFiles()
        assert any("starledger-" in f for f in read) and not any("lineitem" in f for f in read)


def test_staging_follows_the_session(spark):
    assert staging_root(spark).endswith(spark.conf.get("spark.checkpoint.dir").rstrip("/"))


@pytest.mark.parametrize("name", ["e16_top10_customers", "e18_top10_products"])
def test_orders_are_counted_for_winners_only(spark, name):
    """The ranking folds sums by key; the facts of the winners alone meet the distinct count."""
    lines = executed(JOBS[name](spark, SMALL))
    winners = [x for x in lines if "FileScan" in x and "starledger-" in x and "_winner" in x]
    assert winners and "BroadcastNestedLoopJoin" not in "\n".join(lines)
    counts = [i for i, x in enumerate(lines) if "count(distinct" in x or "count(order_number" in x]
    joined = [i for i, x in enumerate(lines) if "Join" in x and "_winner" in x]
    assert counts and joined and min(counts) < min(joined)


@pytest.mark.parametrize(
    "name", ["r01_report_customers", "e21_top10_subcategories", "a09_subcategory_contribution"]
)
def test_no_window_over_a_single_partition_of_groups(spark, name):
    lines = executed(JOBS[name](spark, SMALL))
    single = [x for x in lines if "Exchange SinglePartition" in x]
    windows = [x for x in lines if re.search(r"Window \[(?!.*_slice)", x) and "windowspecdefinition(ROWS" in x]
    assert not windows or not single, "\n".join(lines)


def test_clear_staged_removes_what_was_staged(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(staging, "staging_root", lambda _: str(tmp_path))
    assert staging.stage(spark.range(3)).count() == 3 and list(tmp_path.iterdir())
    staging.clear_staged(spark)
    assert not list(tmp_path.iterdir())


@pytest.mark.parametrize(
    ("folder", "refused"),
    [
        ("/tmp/x", True),
        ("file:///tmp/x", True),
        ("file:/tmp/x", True),
        ("/mnt/shared/x", False),
        ("hdfs://name/tmp/x", False),
        ("s3a://bucket/tmp/x", False),
    ],
)
def test_a_cluster_needs_a_shared_folder(folder, refused):
    cluster = SimpleNamespace(
        conf=SimpleNamespace(get=lambda *_: folder),
        sparkContext=SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None),
    )
    if refused:
        with pytest.raises(RuntimeError, match="one machine"):
            staging_root(cluster)
    else:
        assert staging_root(cluster) == folder
