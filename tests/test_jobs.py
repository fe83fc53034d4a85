"""Every job against its SQL on the small tables, and on a skewed copy of them."""

import shutil

import pytest

import __spark_entry__ as entry
from checks.compare import connect, differences
from checks.oracle import oracle_queries
from starledger.jobs import JOBS
from starledger.sources.order_tables import load_star
from tests.conftest import SMALL

SQL = oracle_queries()


@pytest.fixture(scope="module")
def skewed(tmp_path_factory):
    """The small tables with one customer, one product, one order and one day each
    holding a third of the rows, ties everywhere, facts about unknown keys, and
    missing members, names, categories, countries and order dates."""
    folder = tmp_path_factory.mktemp("skewed")
    connection = connect(SMALL)
    shutil.copy(f"{SMALL}/nation.parquet", folder)
    copies = {
        "customer": """SELECT * REPLACE (
            CASE WHEN c_custkey % 3 = 0 THEN 4 WHEN c_custkey % 50 = 1 THEN NULL ELSE c_nationkey END AS c_nationkey,
            CASE WHEN c_custkey % 70 <> 0 THEN c_name END AS c_name) FROM customer
            WHERE c_custkey % 89 <> 0""",
        "part": """SELECT * REPLACE (
            CASE WHEN p_partkey % 41 = 0 THEN NULL WHEN p_partkey % 3 = 0 THEN 'PROMO' ELSE p_type END AS p_type,
            CASE WHEN p_partkey % 41 <> 0 THEN p_brand END AS p_brand) FROM part
            WHERE p_partkey % 97 <> 0""",
        "orders": """SELECT * REPLACE (
            CASE o_orderkey % 6 WHEN 0 THEN 7 WHEN 1 THEN 7 WHEN 2 THEN 999999 WHEN 3 THEN NULL ELSE o_custkey END AS o_custkey,
            CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 3 = 1 THEN TIMESTAMP '1999-12-31'
                 ELSE o_orderdate END AS o_orderdate) FROM orders
            WHERE o_orderkey % 50 <> 49""",
        "lineitem": """SELECT * REPLACE (
            CASE WHEN l_linenumber % 3 = 0 THEN 5 WHEN l_orderkey % 7 = 0 THEN NULL
                 WHEN l_orderkey % 7 = 1 THEN 888888 ELSE l_partkey END AS l_partkey,
            CASE WHEN l_suppkey % 3 = 0 THEN 12 ELSE l_orderkey END AS l_orderkey,
            CASE WHEN l_partkey % 2 = 0 THEN 30000.0 ELSE l_extendedprice END AS l_extendedprice) FROM lineitem""",
    }
    for name, sql in copies.items():
        connection.execute(f"COPY ({sql}) TO '{folder}/{name}.parquet' (FORMAT parquet)")
    return str(folder)


def test_every_job_is_registered_and_has_its_sql():
    assert set(JOBS) == set(SQL)
    assert set(JOBS) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())


def test_every_row_of_the_tables_is_read(spark):
    """The star derived from the tables leaves nothing out and blanks nothing."""
    star, tables = load_star(spark, SMALL), connect(SMALL)
    for ours, theirs in (("customers", "customer"), ("products", "part"), ("sales", "lineitem")):
        frame = getattr(star, ours)
        assert frame.count() == tables.execute(f"SELECT count(*) FROM {theirs}").fetchone()[0]
        assert frame.dropna().count() == frame.count()


@pytest.mark.parametrize("name", JOBS)
def test_job_equals_sql(spark, name):
    assert differences(JOBS[name](spark, SMALL), connect(SMALL), SQL[name]) == []


@pytest.mark.parametrize("name", JOBS)
def test_job_equals_sql_on_skewed_tables(spark, settings, skewed, name):
    """Without broadcasts, so that the shuffled plans are the ones checked."""
    settings(
        spark__sql__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__coalescePartitions__enabled="false",
    )
    assert differences(JOBS[name](spark, skewed), connect(skewed), SQL[name]) == []


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
