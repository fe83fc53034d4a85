from __future__ import annotations

import os
import sys
from datetime import date

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from starledger import Star  # noqa: E402
from starledger.sources import schema  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[*]")
        .appName("tests")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def settings(spark):
    """Change session settings for one test."""
    before: dict[str, str | None] = {}

    def change(**values: str) -> None:
        for name, value in values.items():
            key = name.replace("__", ".")
            before.setdefault(key, spark.conf.get(key, None))
            spark.conf.set(key, value)

    yield change
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


@pytest.fixture
def make_star(spark):
    """A star from short rows; what a row leaves out is NULL."""

    def table(struct, rows):
        return spark.createDataFrame([tuple(r.get(c) for c in struct.names) for r in rows], struct)

    def make(customers=(), products=(), sales=()) -> Star:
        return Star(
            table(schema.DIM_CUSTOMERS, customers),
            table(schema.DIM_PRODUCTS, products),
            table(schema.FACT_SALES, sales),
        )

    return make


def sale(order, customer, product, day, amount, quantity=1, price=None):
    return {
        "order_number": order,
        "customer_key": customer,
        "product_key": product,
        "order_date": None if day is None else date.fromisoformat(day),
        "sales_amount": amount,
        "quantity": quantity,
        "price": amount if price is None else price,
    }
