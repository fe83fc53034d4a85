import re
from datetime import date

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from starledger.operators.members import resolve_member
from starledger.sources import load, publish, schema, staging
from starledger.sources.catalog import catalog_columns, catalog_tables, column_counts
from starledger.star import dated_sales

HEADER = ",".join(schema.DIM_PRODUCTS.names)
BELL = "1,10,P-1,bell,B_b,Parts,Bells,Yes,5,Road,2010-01-01"
PEDAL = "2,20,P-2,pedal,,,,,7,n/a,2011-01-01"


def write(folder, name, *lines):
    path = folder / name
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def products(spark, tmp_path, *lines, **options):
    return load.load_products(
        spark, write(tmp_path, "p.csv", HEADER, *lines), str(tmp_path / "out"), **options
    )


def test_empty_fields_are_null_and_types_declared(spark, tmp_path):
    rows = {r.product_key: r for r in products(spark, tmp_path, BELL, PEDAL).collect()}
    assert rows[2].category is None and rows[2].category_id is None
    assert (rows[1].cost, rows[1].start_date) == (5, date(2010, 1, 1))


def test_quotes_have_no_meaning(spark, tmp_path):
    got = products(spark, tmp_path, '3,30,P-3,7" wheel,B_b,"x",Bells,Yes,5,Road,2010-01-01').head()
    assert (got.product_name, got.category) == ('7" wheel', '"x"')


def test_reload_replaces(spark, tmp_path):
    assert products(spark, tmp_path, BELL, PEDAL).count() == 2
    assert products(spark, tmp_path, BELL).count() == 1


BAD = [
    "x,30,P-3,bad key,,,,,5,Road,2010-01-01",
    "4,30,P-3,bad date,,,,,5,Road,2010-13-01",
    "5,30,P-3,short line",
    "6,30,P-3,long line,,,,,5,Road,2010-01-01,more",
    f"7,30,P-3,{'n' * 51},,,,,5,Road,2010-01-01",
]


def test_bad_rows_are_skipped_and_kept_aside(spark, tmp_path):
    rejects = str(tmp_path / "rejects")
    got = products(spark, tmp_path, BELL, *BAD, rejects=rejects)
    assert [r.product_key for r in got.collect()] == [1]
    kept = spark.read.json(rejects)
    assert kept.count() == len(BAD)
    assert kept.where("_bad_line LIKE '%short line%'").count() == 1


def test_text_of_fifty_characters_fits(spark, tmp_path):
    assert products(spark, tmp_path, f"7,30,P-3,{'n' * 50},,,,,5,Road,2010-01-01").count() == 1


def test_too_many_bad_rows_empty_the_target(spark, tmp_path):
    products(spark, tmp_path, BELL)
    with pytest.raises(load.LoadError, match="11 bad rows"):
        products(spark, tmp_path, BELL, *[BAD[0]] * 11)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 0
    assert products(spark, tmp_path, BELL, *[BAD[0]] * 10).count() == 1


def test_repeated_dimension_key(spark, tmp_path):
    with pytest.raises(load.LoadError, match="product_key 1 occurs 2 times"):
        products(spark, tmp_path, BELL, BELL)
    no_key = BELL.removeprefix("1")
    assert products(spark, tmp_path, no_key, no_key).count() == 2


def test_swapped_header_is_refused(spark, tmp_path):
    header = HEADER.replace("product_key,product_id", "product_id,product_key")
    source = write(tmp_path, "swapped.csv", header, BELL)
    with pytest.raises(Exception, match="(?i)header"):
        load.load_products(spark, source, str(tmp_path / "out"))


def test_sales_by_year_and_quantity_range(spark, tmp_path):
    header = ",".join(schema.FACT_SALES.names)
    lines = [f"SO{i},1,2,{2010 + i % 3}-05-01,,,100,{q},5" for i, q in enumerate((0, 255, 256, -1))]
    source = write(tmp_path, "s.csv", header, *lines, "SO9,1,2,,,,100,1,5")
    target = tmp_path / "sales"
    got = load.load_sales(spark, source, str(target))
    assert got.columns == [*schema.FACT_SALES.names, load.ORDER_YEAR]
    assert sorted(r.quantity for r in got.collect()) == [0, 1, 255]
    assert sorted(p.name for p in target.glob("order_year=*")) == [
        "order_year=2010",
        "order_year=2011",
        "order_year=__HIVE_DEFAULT_PARTITION__",
    ]
    pruned = got.where("order_year = 2011")
    assert pruned.count() == 1
    plan = pruned._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*order_year", plan)
    dated = dated_sales(got)
    plan = dated._jdf.queryExecution().executedPlan().toString()
    assert dated.count() == 2 and re.search(r"PartitionFilters: \[isnotnull\(order_year", plan)


SALES_HEADER = ",".join(schema.FACT_SALES.names)
GOOD_SALE, BAD_SALE = "SO1,1,2,2010-05-01,,,100,1,5", "SO2,one,2,2010-05-01,,,100,1,5"


@pytest.fixture(params=["path", "catalog"])
def sales_target(request, spark, tmp_path):
    yield str(tmp_path / "sales") if request.param == "path" else "loads.sales"
    spark.sql("DROP SCHEMA IF EXISTS loads CASCADE")


def stored_rows(spark, target):
    if "/" not in target:
        return spark.table(target).count()
    declared = T.StructType([*schema.FACT_SALES.fields, T.StructField(load.ORDER_YEAR, T.IntegerType())])
    return spark.read.schema(declared).parquet(target).count()


@pytest.mark.parametrize(
    ("lines", "loaded"),
    [([], 0), ([BAD_SALE] * 2, 0), ([BAD_SALE] * 11, None), ([GOOD_SALE, *[BAD_SALE] * 11], None)],
)
@pytest.mark.filterwarnings("ignore::starledger.sources.load.SkippedRows")
def test_sales_without_good_rows(spark, tmp_path, sales_target, lines, loaded):
    first = write(tmp_path, "first.csv", SALES_HEADER, GOOD_SALE)
    assert load.load_sales(spark, first, sales_target).count() == 1
    source = write(tmp_path, "s.csv", SALES_HEADER, *lines)
    if loaded is None:
        with pytest.raises(load.LoadError, match="11 bad rows") as refused:
            load.load_sales(spark, source, sales_target)
        assert spark.read.json(refused.value.rejects).count() == refused.value.bad_rows == 11
    else:
        assert load.load_sales(spark, source, sales_target).count() == loaded
    assert stored_rows(spark, sales_target) == 0


def test_skipped_rows_are_told_and_kept(spark, tmp_path):
    """Blank lines are bad rows too, and no folder has to be named to find them all."""
    source = write(tmp_path, "s.csv", SALES_HEADER, GOOD_SALE, "", BAD_SALE, "   ", GOOD_SALE)
    with pytest.warns(load.SkippedRows) as told:
        got = load.load_sales(spark, source, str(tmp_path / "sales"))
    assert got.count() == 2
    skipped = next(w.message for w in told if w.category is load.SkippedRows)
    assert skipped.bad_rows == 3 and skipped.rejects in str(skipped)
    kept = spark.read.json(skipped.rejects)
    assert sorted(r[load.BAD_LINE].strip() for r in kept.collect()) == ["", "", BAD_SALE]


def test_nothing_is_told_without_bad_rows(spark, tmp_path, recwarn):
    products(spark, tmp_path, BELL)
    assert not [w for w in recwarn if w.category is load.SkippedRows]


def test_catalog_target(spark, tmp_path):
    source = write(tmp_path, "p.csv", HEADER, BELL)
    stored = load.load_products(spark, source, "gold.dim_products")
    assert stored.count() == 1 and spark.table("gold.dim_products").count() == 1
    assert load.load_products(spark, source, "gold.dim_products").count() == 1
    tables = catalog_tables(spark, "gold").collect()
    assert [(t.table_schema, t.table_name, t.table_type) for t in tables] == [
        ("gold", "dim_products", "BASE TABLE")
    ]
    columns = catalog_columns(spark, "gold").orderBy("ordinal_position").collect()
    assert [c.column_name for c in columns] == schema.DIM_PRODUCTS.names
    assert [tuple(r) for r in column_counts(spark, "gold").collect()] == [("Products", 11)]
    spark.sql("DROP SCHEMA gold CASCADE")


@pytest.mark.parametrize("table", ["products", "sales"])
def test_the_source_is_read_once(spark, tmp_path, monkeypatch, table):
    """After the staging write the source is gone, and the load still ends."""
    lines = {"products": (HEADER, BELL, BAD[0], PEDAL), "sales": (SALES_HEADER, GOOD_SALE, "", BAD_SALE)}[table]
    source, staged = write(tmp_path, "once.csv", *lines), []

    def stage_and_remove(df):
        staged.append(staging.stage(df))
        (tmp_path / "once.csv").unlink()
        return staged[-1]

    monkeypatch.setattr(load, "stage", stage_and_remove)
    loader = {"products": load.load_products, "sales": load.load_sales}[table]
    with pytest.warns(load.SkippedRows):
        got = loader(spark, source, str(tmp_path / "out"))
    assert got.count() == {"products": 2, "sales": 1}[table] and len(staged) == 1


@pytest.mark.filterwarnings("ignore::starledger.sources.load.SkippedRows")
def test_several_files_each_with_its_header(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    write(folder, "1.csv", "\ufeff" + HEADER.upper(), BELL)
    write(folder, "2.csv", HEADER, PEDAL, "")
    (folder / "3.csv").write_text("")
    assert load.load_products(spark, str(folder), str(tmp_path / "out")).count() == 2
    write(folder, "4.csv", BELL.replace("1,", "4,", 1))
    with pytest.raises(load.LoadError, match="4.csv has no header"):
        load.load_products(spark, str(folder), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def failing(spark, rows):
    """Rows of which some are written before one fails."""
    return spark.range(rows, numPartitions=4).selectExpr(
        "'SO' || id AS order_number", "id AS customer_key",
        f"CAST(IF(id = {rows} - 1, raise_error('lost'), 2010) AS INT) AS order_year",
    )


@pytest.mark.parametrize(("kind", "clustered"), [("path", False), ("catalog", False), ("catalog", True)])
def test_a_write_that_fails_leaves_the_table(spark, tmp_path, kind, clustered):
    target = str(tmp_path / "sales") if kind == "path" else "versions.sales"
    layout = publish.Layout("order_year", "customer_key", 4) if clustered else publish.Layout("order_year")
    good = spark.createDataFrame(
        [(f"SO{i}", i, 2010 + i % 2) for i in range(7)], "order_number string, customer_key long, order_year int"
    )
    assert publish.publish(good, target, layout).count() == 7
    running = spark.read.parquet(target) if kind == "path" else spark.table(target)
    with pytest.raises(Exception, match="lost"):
        publish.publish(failing(spark, 100), target, layout)
    again = spark.read.parquet(target) if kind == "path" else spark.table(target)
    assert running.count() == again.count() == 7
    assert publish.publish(good.limit(3), target, layout).count() == 3
    spark.sql("DROP SCHEMA IF EXISTS versions CASCADE")


def test_a_running_query_keeps_its_version(spark):
    """The version before stays until the publish after next; older ones go."""
    sizes = [spark.range(n) for n in (5, 6, 7)]
    first = publish.publish(sizes[0], "versions.t")
    second = publish.publish(sizes[1], "versions.t")
    assert (first.count(), second.count(), spark.table("versions.t").count()) == (5, 6, 6)
    assert publish.publish(sizes[2], "versions.t").count() == 7 and second.count() == 6
    with pytest.raises(Exception, match="(?i)not.?exist"):
        first.collect()
    assert publish.publish(spark.range(2).toDF("other"), "versions.t").columns == ["other"]
    spark.sql("DROP SCHEMA versions CASCADE")


def test_clustered_facts_are_counted_and_joined_without_a_shuffle(spark, tmp_path, settings):
    settings(
        spark__sql__autoBroadcastJoinThreshold="-1", spark__sql__adaptive__autoBroadcastJoinThreshold="-1"
    )
    lines = [f"SO{i % 40},1,{i % 9},{2010 + i % 3}-05-01,,,100,1,5" for i in range(200)]
    source = write(tmp_path, "s.csv", SALES_HEADER, *lines)
    sales = load.load_sales(spark, source, "versions.facts", cluster_by="customer_key", buckets=4)
    assert sales.count() == 200
    counted = sales.groupBy("customer_key").agg(F.count_distinct("order_number").alias("n"))
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Bucketed: true" in plan
    assert sum(r["n"] for r in counted.collect()) == len({(i % 40, i % 9) for i in range(200)})
    customers = spark.range(9).selectExpr("CAST(id AS INT) AS customer_key")
    joined = resolve_member(sales, customers, "customer_key")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("Exchange") == 1, plan  # that of the customers
    assert joined.where("customer_key IS NULL").count() == 0
    with pytest.raises(ValueError, match="catalog"):
        load.load_sales(spark, source, str(tmp_path / "out"), cluster_by="customer_key")
    spark.sql("DROP SCHEMA versions CASCADE")


def test_missing_source(spark, tmp_path):
    with pytest.raises(AnalysisException):
        load.load_customers(spark, str(tmp_path / "none.csv"), str(tmp_path / "out"))
