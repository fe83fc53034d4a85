"""Publishing a table in place of the one before.

A table is written whole under a new name first, and then becomes the target in one step. A
write that fails half way leaves the target as it was.

- A catalog table is a pointer: its location is switched to the folder of the new version. The folder of the version
  before stays until the next publish, so queries that run meanwhile end on what they began with.
- A path is swapped by renaming folders: a queue of two renames, each of which is one step in
  HDFS and on local disks. Object stores copy instead, so keep tables of such stores in the catalog.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

LAYOUT = "starledger.layout"
TRACKED = "spark.sql.hive.manageFilesourcePartitions"


@dataclass(frozen=True)
class Layout:
    """How a table is cut: by the values of one column, and by the hash of another."""

    partition_by: str | None = None
    cluster_by: str | None = None
    buckets: int = 0


def publish(df: DataFrame, target: str, layout: Layout = Layout()) -> DataFrame:
    """Write ``df`` as the new content of a path or catalog table, and return the stored table."""
    if "/" in target:
        if layout.cluster_by:
            raise ValueError("only a catalog table can be clustered by a key")
        return _publish_path(df, target, layout)
    return _publish_table(df, target, layout)


def _spread(df: DataFrame, layout: Layout) -> DataFrame:
    """As the files are to be: a bucket is one task's, else AQE sizes the parts of each folder."""
    if layout.cluster_by:
        return df.repartition(layout.buckets, layout.cluster_by)
    return df.hint("rebalance", layout.partition_by) if layout.partition_by else df


def _writer(df: DataFrame, layout: Layout):
    writer = _spread(df, layout).write.format("parquet")
    return writer.partitionBy(layout.partition_by) if layout.partition_by else writer


# --- paths -------------------------------------------------------------------------


def _files(spark: SparkSession, path: str):
    """A Hadoop path and the file system it is in."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _publish_path(df: DataFrame, target: str, layout: Layout) -> DataFrame:
    spark, target = df.sparkSession, target.rstrip("/")
    version = uuid.uuid4().hex
    new, old = f"{target}.new-{version}", f"{target}.old-{version}"
    _writer(df, layout).save(new)
    (here, files), (there, _), (aside, _) = (_files(spark, p) for p in (target, new, old))
    replaced = files.exists(here)
    if replaced and not files.rename(here, aside):
        raise OSError(f"{target} could not be put aside; the new version is in {new}")
    if not files.rename(there, here):
        if replaced:
            files.rename(aside, here)
        raise OSError(f"{new} could not become {target}")
    if replaced:
        files.delete(aside, True)
    # with the declared schema: a target without rows may hold no file to read one from
    return spark.read.schema(df.schema).parquet(target)


# --- catalog tables ------------------------------------------------------------------


def _publish_table(df: DataFrame, target: str, layout: Layout) -> DataFrame:
    spark = df.sparkSession
    schema, _, name = target.rpartition(".")
    schema = schema or spark.catalog.currentDatabase()
    spark.sql(f"CREATE SCHEMA IF NOT EXISTS {schema}")
    versions = f"{spark.catalog.getDatabase(schema).locationUri.rstrip('/')}/{name}.versions"
    version = uuid.uuid4().hex
    folder = f"{versions}/{version}"
    table = f"{schema}.{name}"

    if layout.cluster_by:  # buckets can only be written as a table, which is forgotten again
        writing = f"{schema}.{name}_{version}"
        with _untracked(spark):
            _writer(df, layout).bucketBy(layout.buckets, layout.cluster_by).option("path", folder).saveAsTable(writing)
            spark.sql(f"DROP TABLE {writing}")
    else:
        _writer(df, layout).save(folder)

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    shape = f"({columns}) USING parquet"
    if layout.partition_by:
        shape += f" PARTITIONED BY (`{layout.partition_by}`)"
    if layout.cluster_by:
        shape += f" CLUSTERED BY (`{layout.cluster_by}`) INTO {layout.buckets} BUCKETS"
    digest = hashlib.sha256(shape.encode()).hexdigest()
    before = _location(spark, table)
    if before is not None and _property(spark, table) == digest:
        spark.sql(f"ALTER TABLE {table} SET LOCATION '{folder}'")
        spark.catalog.refreshTable(table)
    else:  # another shape needs another table
        with _untracked(spark):
            spark.sql(f"DROP TABLE IF EXISTS {table}")
            spark.sql(f"CREATE TABLE {table} {shape} LOCATION '{folder}' TBLPROPERTIES ('{LAYOUT}' = '{digest}')")
    _forget(spark, versions, {folder, before})
    return spark.table(table)


@contextmanager
def _untracked(spark: SparkSession) -> Iterator[None]:
    """Tables made meanwhile find their partitions in their folder, so one step moves them all."""
    setting = spark.conf.get(TRACKED)
    spark.conf.set(TRACKED, "false")
    try:
        yield
    finally:
        spark.conf.set(TRACKED, setting)


def _location(spark: SparkSession, table: str) -> str | None:
    if not spark.catalog.tableExists(table):
        return None
    described = spark.sql(f"DESCRIBE FORMATTED {table}").where("col_name = 'Location'").first()
    return described["data_type"] if described else None


def _property(spark: SparkSession, table: str) -> str | None:
    found = spark.sql(f"SHOW TBLPROPERTIES {table}").where(f"key = '{LAYOUT}'").first()
    return found["value"] if found else None


def _forget(spark: SparkSession, versions: str, kept: set[str | None]) -> None:
    """Delete the versions but those that are in ``kept``: older ones, and what failed loads left."""
    folder, files = _files(spark, versions)
    names = {k.rstrip("/").rsplit("/", 1)[1] for k in kept if k}
    if files.exists(folder):
        for status in files.listStatus(folder):
            if status.getPath().getName() not in names:
                files.delete(status.getPath(), True)
