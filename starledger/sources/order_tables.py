"""The sales star derived from order-entry tables (customer, part, orders, lineitem)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from starledger.star import Star

# Declared, so that opening a table costs no job to look for its schema.
COLUMNS = {
    "customer": "c_custkey bigint, c_name string, c_nationkey int",
    "nation": "n_nationkey int, n_name string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp_ntz",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_quantity double, "
    "l_extendedprice double, l_shipdate timestamp_ntz",
}


def load_star(spark: SparkSession, folder: str, with_orders: bool = True) -> Star:
    """Star over the Parquet tables in ``folder``.

    ``with_orders=False`` leaves out the fact columns that come from the orders
    table (customer and order dates) and with them the largest join; jobs that
    look at products only do not need it.
    """

    def table(name: str) -> DataFrame:
        return spark.read.schema(COLUMNS[name]).parquet(f"{folder}/{name}.parquet")

    lines = table("lineitem")
    return Star(
        customers=_customers(table("customer"), table("nation")),
        products=_products(table("part")),
        sales=_sales(lines, table("orders")) if with_orders else lines.select(*_line_columns()),
        derived=with_orders,
    )


def _customers(customer: DataFrame, nation: DataFrame) -> DataFrame:
    key, name = F.col("c_custkey"), F.col("c_name")
    birthdate = F.date_add(F.lit("1940-01-01").cast("date"), (key * 137 % 24000).cast("int"))
    return (
        customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .select(
            key.alias("customer_key"),
            (key + 11000).alias("customer_id"),
            name.alias("customer_number"),
            F.split_part(name, F.lit("#"), F.lit(1)).alias("first_name"),
            F.split_part(name, F.lit("#"), F.lit(2)).alias("last_name"),
            F.col("n_name").alias("country"),
            F.when(key % 2 == 0, "Married").otherwise("Single").alias("marital_status"),
            F.when(key % 3 == 0, "Male").when(key % 3 == 1, "Female").otherwise("n/a").alias("gender"),
            birthdate.alias("birthdate"),
            F.lit("1994-01-01").cast("date").alias("create_date"),
        )
    )


def _products(part: DataFrame) -> DataFrame:
    key = F.col("p_partkey")
    return part.select(
        key.alias("product_key"),
        (key + 210).alias("product_id"),
        F.concat(F.lit("P-"), key).alias("product_number"),
        F.concat("p_name", F.lit(" "), key).alias("product_name"),
        F.concat("p_type", F.lit("_"), "p_brand").alias("category_id"),
        F.col("p_type").alias("category"),
        F.col("p_brand").alias("subcategory"),
        F.when(key % 2 == 0, "Yes").otherwise("No").alias("maintenance"),
        (key * 7 % 2200).cast("int").alias("cost"),
        F.col("p_type").alias("product_line"),
        F.lit("1994-01-01").cast("date").alias("start_date"),
    )


def _line_columns() -> list[Column]:
    return [
        F.concat(F.lit("SO"), "l_orderkey").alias("order_number"),
        F.col("l_partkey").alias("product_key"),
        F.col("l_shipdate").cast("date").alias("shipping_date"),
        F.floor(F.col("l_extendedprice") / 200).cast("int").alias("sales_amount"),
        F.col("l_quantity").cast("smallint").alias("quantity"),
        F.floor(F.col("l_extendedprice") / 200 / F.col("l_quantity")).cast("int").alias("price"),
    ]


def _sales(lines: DataFrame, orders: DataFrame) -> DataFrame:
    """One row per order line; a line without its order stays, undated."""
    order_date = F.col("o_orderdate").cast("date")
    number, product, shipped, *amounts = _line_columns()
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left").select(
        number,
        product,
        F.col("o_custkey").alias("customer_key"),
        order_date.alias("order_date"),
        shipped,
        F.date_add(order_date, 12).alias("due_date"),
        *amounts,
    )
