"""What the catalog knows about a schema, as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starledger.functions.semantics import subject_name


def catalog_tables(spark: SparkSession, schema: str) -> DataFrame:
    """Tables and views of a schema with their type."""
    rows = [
        (t.catalog, schema, t.name, "VIEW" if t.tableType == "VIEW" else "BASE TABLE")
        for t in spark.catalog.listTables(schema)
        if not t.isTemporary
    ]
    return spark.createDataFrame(
        rows, "table_catalog string, table_schema string, table_name string, table_type string"
    )


def catalog_columns(spark: SparkSession, schema: str) -> DataFrame:
    """Columns of every table of a schema, in order."""
    rows = [
        (schema, t.name, i, c.name, c.dataType, c.nullable)
        for t in spark.catalog.listTables(schema)
        if not t.isTemporary
        for i, c in enumerate(spark.catalog.listColumns(f"{schema}.{t.name}"), start=1)
    ]
    return spark.createDataFrame(
        rows,
        "table_schema string, table_name string, ordinal_position int, "
        "column_name string, data_type string, is_nullable boolean",
    )


def column_counts(spark: SparkSession, schema: str) -> DataFrame:
    """Number of columns per table, under the table's subject name."""
    per_table = catalog_columns(spark, schema).groupBy("table_name").count()
    return per_table.select(
        subject_name(F.col("table_name")).alias("table_name"),
        F.col("count").alias("number_of_columns"),
    )
