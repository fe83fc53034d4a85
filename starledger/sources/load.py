"""Typed full-refresh loads of the star tables from delimited text.

A load replaces its target. A row is bad when a field does not convert, a field
is missing or left over, a text is longer than 50 characters, or a quantity
does not fit an unsigned byte; so is a blank line. The source is read once, as lines: they are parsed and
written to the staging folder with their verdict, and all that follows reads this table. So bad rows are counted
from what was committed (a task that runs twice counts once), the load is judged before
its target is touched, and what is published is what was judged. Up to ``max_errors`` bad rows are skipped, with a
warning that says where they are kept; more than that fail the load and leave the target
empty.

A load that fails leaves the table of the load before (see :mod:`starledger.sources.publish`).
"""

from __future__ import annotations

import warnings
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starledger.sources import schema as S
from starledger.sources.publish import Layout, publish
from starledger.sources.staging import stage, staging_path

BAD_LINE = "_bad_line"
ORDER_YEAR = "order_year"
HEADER, BLANK, BAD, GOOD = "header", "blank", "bad", "good"


class LoadError(Exception):
    """A load that left its target empty. ``bad_rows`` are kept in ``rejects``."""

    def __init__(self, message: str, bad_rows: int = 0, rejects: str | None = None):
        super().__init__(message)
        self.bad_rows, self.rejects = bad_rows, rejects


class SkippedRows(UserWarning):
    """Bad rows that a load left out: ``bad_rows`` of them, kept in ``rejects``."""

    def __init__(self, message: str, bad_rows: int, rejects: str):
        super().__init__(message)
        self.bad_rows, self.rejects = bad_rows, rejects


def load_customers(spark: SparkSession, source: str, target: str, **options) -> DataFrame:
    return _load(spark, source, target, S.DIM_CUSTOMERS, key="customer_key", **options)


def load_products(spark: SparkSession, source: str, target: str, **options) -> DataFrame:
    return _load(spark, source, target, S.DIM_PRODUCTS, key="product_key", **options)


def load_sales(
    spark: SparkSession,
    source: str,
    target: str,
    cluster_by: str | None = None,
    buckets: int = 64,
    **options,
) -> DataFrame:
    """The fact table, stored by order year; a filter on ``order_year`` reads those years only.

    The rebalance hint lets AQE cut a large year into several files and put
    small ones together, so neither a dominant year nor unsorted input decides
    the size of the files.

    ``cluster_by`` names a key (``customer_key``, ``product_key`` or ``order_number``) by whose
    hash a catalog table is also cut into ``buckets``, the same in every year. Grouping, distinct counts and joins
    by that key then shuffle no facts. A key that holds much of the
    table makes one large bucket; leave such tables unclustered.
    """
    layout = Layout(ORDER_YEAR, cluster_by, buckets if cluster_by else 0)
    return _load(spark, source, target, S.FACT_SALES, layout=layout, **options)


def _load(
    spark: SparkSession,
    source: str,
    target: str,
    schema: T.StructType,
    key: str | None = None,
    layout: Layout = Layout(),
    long_keys: bool = False,
    max_errors: int = 10,
    rejects: str | None = None,
) -> DataFrame:
    """Load ``source`` (file, folder or glob) and return the stored table.

    ``target`` is a path, or a catalog table as ``schema.table``. ``rejects``
    names a folder for the text of bad rows, by default one in the staging folder.
    """
    schema = S.with_long_keys(schema) if long_keys else schema
    judged = stage(judged_lines(spark, source, schema))
    headless = (
        judged.groupBy("_file").agg(F.max(F.col("_verdict") == HEADER).alias("named")).where("NOT named").first()
    )
    if headless is not None:
        raise LoadError(f"{headless['_file']} has no header line {','.join(schema.names)}")

    good = judged.where(F.col("_verdict") == GOOD).select(*schema.names)
    if layout.partition_by:
        good = good.withColumn(ORDER_YEAR, F.year("order_date"))
    bad = judged.where(F.col("_verdict").isin(BAD, BLANK))
    bad_rows = bad.count()
    rejects = rejects or staging_path(spark)
    if bad_rows:
        bad.select(BAD_LINE, *schema.names).write.mode("overwrite").json(rejects)
    refusal = None
    if bad_rows > max_errors:
        refusal = f"{bad_rows} bad rows in {source}, at most {max_errors} allowed"
    elif key is not None:
        repeated = good.where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1")
        example = repeated.limit(1).collect()
        if example:
            refusal = f"{key} {example[0][key]} occurs {example[0]['count']} times in {source}"
    if refusal is not None:
        publish(good.limit(0), target, layout)
        raise LoadError(refusal, bad_rows, rejects)

    stored = publish(good, target, layout)
    if bad_rows:
        message = f"{bad_rows} bad rows of {source} were skipped; they are in {rejects}"
        warnings.warn(SkippedRows(message, bad_rows, rejects), stacklevel=3)
    return stored


def judged_lines(spark: SparkSession, source: str, schema: T.StructType) -> DataFrame:
    """Every line of comma-separated text without quoting: its fields, verdict, file, and text if it is no row.

    An empty field is NULL. A line that reads like the schema's names is a header wherever it stands.
    """
    line = F.ltrim(F.col("value"), F.lit("\ufeff"))
    parsed = F.from_csv(
        line,
        ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields) + f", `{BAD_LINE}` string",
        {
            "quote": "",
            "mode": "PERMISSIVE",
            "columnNameOfCorruptRecord": BAD_LINE,
            "dateFormat": "yyyy-MM-dd",
        },
    )
    lines = spark.read.text(source).select(
        line.alias("_line"), F.col("_metadata.file_path").alias("_file"), parsed.alias("_row")
    )
    fields = lines.select("_line", "_file", "_row.*")
    verdict = (
        F.when(F.lower("_line") == ",".join(schema.names), HEADER)
        .when(F.trim("_line") == "", BLANK)
        .when(_is_bad(schema), BAD)
        .otherwise(GOOD)
    )
    return fields.withColumn("_verdict", verdict).select(
        *schema.names,
        F.when(F.col("_verdict").isin(BAD, BLANK), F.col("_line")).alias(BAD_LINE),
        "_file",
        "_verdict",
    )


def _is_bad(schema: T.StructType) -> Column:
    checks = [F.col(BAD_LINE).isNotNull()]
    for field in schema.fields:
        column = F.col(field.name)
        if isinstance(field.dataType, T.StringType):
            checks.append(F.char_length(column) > S.TEXT_LIMIT)
        elif isinstance(field.dataType, T.ShortType):
            checks.append(~column.between(*S.QUANTITY_RANGE))
    return reduce(or_, [F.coalesce(check, F.lit(False)) for check in checks])
