import random
from fractions import Fraction

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from starledger.functions.semantics import asc, desc
from starledger.operators.distinct import aggregate_distinct_apart
from starledger.operators.means import mean_quotient
from starledger.operators.members import additive_by_attributes, additive_by_member, resolve_member
from starledger.operators.ranking import SlicedOrder, rank_values, tile, top_ranked
from starledger.operators.sketches import estimate, merged, with_sketches
from starledger.operators.totals import over_groups, over_members, with_total_row
from starledger.plans import trends
from starledger.sources.order_tables import load_star
from tests.conftest import SMALL


def members(spark, rows):
    return spark.createDataFrame(rows, "id int, land string, v bigint, n int")


def random_rows(count, values, seed):
    """A third of the rows share one value, another part has none."""
    rnd = random.Random(seed)
    rows = []
    for i in range(count):
        v = 7 if i % 3 == 0 else rnd.choice([None, *range(-values, values)])
        rows.append((i, rnd.choice(["A", "A", "A", "B", None]), v, rnd.randint(1, 5)))
    return rows


@pytest.mark.parametrize("count, values, seed", [(400, 3, 1), (500, 400, 2), (61, 10, 3), (3, 2, 4), (1, 1, 5)])
def test_sliced_ranks_equal_plain_windows(spark, settings, count, values, seed):
    settings(spark__sql__adaptive__coalescePartitions__enabled="false")
    df = members(spark, random_rows(count, values, seed))
    got = SlicedOrder(df, "v", ["id"], within="land").ranked(
        "rank", total="total", within_rank="land_rank", ntiles={"t10": 10, "t4": 4}
    )
    by_value, positions = Window.orderBy(*desc("v")), Window.orderBy(*desc("v"), *asc("id"))
    wanted = df.select(
        "*",
        F.dense_rank().over(by_value).alias("rank"),
        F.sum("v").over(Window.partitionBy()).alias("total"),
        F.dense_rank().over(Window.partitionBy("land").orderBy(*desc("v"))).alias("land_rank"),
        F.ntile(10).over(positions).alias("t10"),
        F.ntile(4).over(positions).alias("t4"),
    )
    names = wanted.columns
    assert {tuple(r) for r in got.select(names).collect()} == {tuple(r) for r in wanted.collect()}
    assert got.count() == count


def test_one_value_over_all_rows_is_cut_into_slices(spark, settings):
    settings(spark__sql__adaptive__coalescePartitions__enabled="false")
    order = SlicedOrder(members(spark, [(i, "A", 5, 1) for i in range(800)]), "v", ["id"])
    sizes = [r["count"] for r in order.rows.groupBy("_slice").count().collect()]
    assert len(sizes) > 4 and max(sizes) < 400
    assert {r.rank for r in order.ranked("rank").collect()} == {1}


def test_sliced_order_of_nothing(spark):
    df = members(spark, [])
    got = SlicedOrder(df, "v", ["id"], within="land").ranked("rank", within_rank="w", ntiles={"t": 4})
    assert got.collect() == [] and got.columns == [*df.columns, "rank", "t", "w"]


@pytest.mark.parametrize("rows", range(0, 14))
def test_tile_sizes(spark, rows):
    df = spark.range(1, rows + 1).select("id", tile(F.col("id"), F.lit(rows), 4).alias("t"))
    wanted = spark.range(1, rows + 1).select("id", F.ntile(4).over(Window.orderBy("id")).alias("t"))
    assert sorted(df.collect()) == sorted(wanted.collect())


def test_rank_values(spark):
    df = members(spark, random_rows(200, 20, 9))
    got = rank_values(df, "n", "r").select("id", "r")
    wanted = df.select("id", F.dense_rank().over(Window.orderBy(*desc("n"))).alias("r"))
    assert sorted(got.collect()) == sorted(wanted.collect())


def test_top_ranked_keeps_every_tie(spark):
    rows = [(i, "A", v, 1) for i, v in enumerate([9, 9, 9, 8, 7, 7, 6, None])]
    got = top_ranked(members(spark, rows), "v", 3, "r").select("v", "r").collect()
    assert sorted((r.v, r.r) for r in got) == [(7, 3), (7, 3), (8, 2), (9, 1), (9, 1), (9, 1)]
    assert top_ranked(members(spark, rows), "v", 10, "r").count() == 8


@pytest.fixture
def facts(spark):
    return spark.createDataFrame(
        [("o1", 1, 10), ("o1", 2, 5), ("o2", 8, 1), ("o3", 9, 2), ("o2", None, 4), ("o4", 8, None)],
        "o string, k int, x int",
    )


@pytest.fixture
def dimension(spark):
    return spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (None, "never")], "k int, name string")


def test_unknown_keys_share_one_group(facts, dimension):
    got = (
        resolve_member(facts, dimension, "k")
        .groupBy("k")
        .agg(F.count_distinct("o").alias("orders"), F.sum("x").alias("x"))
    )
    assert {tuple(r) for r in got.collect()} == {(1, 1, 10), (2, 1, 5), (None, 3, 7)}


def test_additive_sums_match_a_join_at_fact_grain(facts, dimension):
    by_member = additive_by_member(facts, dimension, "k", {"s": "x"})
    assert {tuple(r) for r in by_member.collect()} == {(1, 10), (2, 5), (None, 7)}
    by_name = additive_by_attributes(facts, dimension, "k", ["name"], {"s": "x"})
    assert {tuple(r) for r in by_name.collect()} == {("a", 15), (None, 7)}


def test_distinct_counts_apart(facts):
    got = aggregate_distinct_apart(facts, "k", [F.sum("x").alias("s")], {"orders": "o", "amounts": "x"})
    wanted = facts.groupBy("k").agg(
        F.count_distinct("o").alias("orders"), F.sum("x").alias("s"), F.count_distinct("x").alias("amounts")
    )
    assert got.columns == wanted.columns
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in wanted.collect()}
    whole = aggregate_distinct_apart(facts, None, [F.sum("x").alias("s")], {"orders": "o", "keys": "k"})
    assert [tuple(r) for r in whole.collect()] == [(4, 22, 4)]


def test_total_row_adds_up_the_groups(facts):
    grouped = facts.groupBy("o").agg(F.sum("x").alias("s"))
    detail = grouped.withColumn("whole", over_groups("s"))
    assert {r.w for r in grouped.withColumn("w", over_members(grouped, "s")).collect()} == {22}
    total = grouped.agg(F.sum("s").alias("s")).withColumn("o", F.lit("Total"))
    got = with_total_row(detail, total, "s").collect()
    assert [tuple(r) for r in got] == [
        ("Total", 22, None),
        ("o1", 15, 22),
        ("o2", 5, 22),
        ("o3", 2, 22),
        ("o4", None, 22),
    ]


def test_mean_of_quotients_has_the_same_bits_however_facts_are_cut(spark):
    """A plain average of these differs in its last bits with the order of its terms."""
    rows = [(i % 3 if i % 50 else None, (i * 7919) % 1009 - 200, (i * 31) % 13) for i in range(3000)]
    rows += [(0, None, 3), (1, 5, None), (9, 5, 0), (9, None, None)]
    facts = spark.createDataFrame(rows, "key int, amount int, quantity short")
    found = set()
    for parts in (1, 8, 200):
        got = mean_quotient(facts.repartition(parts), "key", "amount", "quantity", "mean").collect()
        found.add(tuple(sorted((str(r["key"]), r["mean"].hex()) for r in got)))
    assert len(found) == 1
    want = {}
    for key, amount, quantity in rows:
        if amount is not None and quantity:
            want.setdefault(str(key), []).append(Fraction(amount, quantity))
    means = {key: float.fromhex(text) for key, text in found.pop()}
    assert means.keys() == want.keys()
    for key, terms in want.items():
        assert means[key] == pytest.approx(float(sum(terms) / len(terms)), rel=1e-13)


def test_sketches_merge_and_stay_within_their_error(spark):
    facts = spark.range(60_000).selectExpr(
        "id % 12 AS month", "concat('SO', id DIV 2) AS order_number", "CAST(id % 9000 AS SMALLINT) AS customer_key"
    )
    monthly = with_sketches(facts, ["month"], [], {"orders": "order_number", "customers": "customer_key"})
    exact = {
        r["month"]: (r["o"], r["c"])
        for r in facts.groupBy("month")
        .agg(F.count_distinct("order_number").alias("o"), F.count_distinct("customer_key").alias("c"))
        .collect()
    }
    for r in monthly.select("month", estimate("orders").alias("o"), estimate("customers").alias("c")).collect():
        assert r["o"] == pytest.approx(exact[r["month"]][0], rel=0.04)
        assert r["c"] == pytest.approx(exact[r["month"]][1], rel=0.04)
    whole = monthly.agg(estimate(merged("orders")).alias("o"), estimate(merged("customers")).alias("c")).first()
    assert whole["o"] == pytest.approx(30_000, rel=0.04) and whole["c"] == pytest.approx(9_000, rel=0.04)


@pytest.mark.parametrize("job", [trends.monthly_trend, trends.yearly_trend, trends.seasonality])
def test_trends_from_a_rollup_of_sketches(spark, job):
    star = load_star(spark, SMALL)
    exact = [r.asDict() for r in job(star).collect()]
    rollup = trends.monthly_rollup(star)
    for got in (job(star, approx=True), job(star, approx=True, rollup=rollup)):
        rows = [r.asDict() for r in got.collect()]
        assert len(rows) == len(exact) and got.columns == list(exact[0])
        for row, want in zip(rows, exact, strict=True):
            for name, value in want.items():
                if name in ("total_orders", "total_customers"):
                    assert row[name] == pytest.approx(value, rel=0.04)
                else:
                    assert row[name] == value
