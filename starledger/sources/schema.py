"""Declared schemas of the three star tables. Every column may be NULL."""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values: table and column names, and their types -------------------

TEXT_LIMIT = 50
QUANTITY_RANGE = (0, 255)

DIM_CUSTOMERS = T.StructType(
    [
        T.StructField("customer_key", T.IntegerType()),
        T.StructField("customer_id", T.IntegerType()),
        T.StructField("customer_number", T.StringType()),
        T.StructField("first_name", T.StringType()),
        T.StructField("last_name", T.StringType()),
        T.StructField("country", T.StringType()),
        T.StructField("marital_status", T.StringType()),
        T.StructField("gender", T.StringType()),
        T.StructField("birthdate", T.DateType()),
        T.StructField("create_date", T.DateType()),
    ]
)

DIM_PRODUCTS = T.StructType(
    [
        T.StructField("product_key", T.IntegerType()),
        T.StructField("product_id", T.IntegerType()),
        T.StructField("product_number", T.StringType()),
        T.StructField("product_name", T.StringType()),
        T.StructField("category_id", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("subcategory", T.StringType()),
        T.StructField("maintenance", T.StringType()),
        T.StructField("cost", T.IntegerType()),
        T.StructField("product_line", T.StringType()),
        T.StructField("start_date", T.DateType()),
    ]
)

FACT_SALES = T.StructType(
    [
        T.StructField("order_number", T.StringType()),
        T.StructField("product_key", T.IntegerType()),
        T.StructField("customer_key", T.IntegerType()),
        T.StructField("order_date", T.DateType()),
        T.StructField("shipping_date", T.DateType()),
        T.StructField("due_date", T.DateType()),
        T.StructField("sales_amount", T.IntegerType()),
        T.StructField("quantity", T.ShortType()),  # unsigned byte, 0..255
        T.StructField("price", T.IntegerType()),
    ]
)


def with_long_keys(schema: T.StructType) -> T.StructType:
    """The same table with 64-bit ``*_key`` and ``*_id`` columns."""
    return T.StructType(
        [
            T.StructField(f.name, T.LongType())
            if isinstance(f.dataType, T.IntegerType) and f.name.endswith(("_key", "_id"))
            else f
            for f in schema.fields
        ]
    )
