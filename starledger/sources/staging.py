"""Intermediate tables in shared storage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_root: tempfile.TemporaryDirectory | None = None


def staging_root(spark: SparkSession) -> str:
    """Folder for intermediate tables: the session's checkpoint folder.

    Only a ``local[...]`` session, where all tasks share this machine, may go
    without one; it gets a temporary folder that ends with the process.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    local = spark.sparkContext.master.startswith("local")
    if configured:
        if not local and _is_temporary(configured):
            raise RuntimeError(f"spark.checkpoint.dir is {configured}, a folder of one machine")
        return configured.rstrip("/")
    if not local:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    global _local_root
    if _local_root is None:
        _local_root = tempfile.TemporaryDirectory(prefix="starledger-")
    return _local_root.name


def _is_temporary(path: str) -> bool:
    """Whether a path without another file system lies in this machine's temporary folder."""
    scheme, _, rest = path.rpartition(":")
    plain = "/" + rest.lstrip("/")
    return scheme in ("", "file") and plain.startswith((tempfile.gettempdir() + "/", "/tmp/"))


def _session_folder(spark: SparkSession) -> str:
    return f"{staging_root(spark)}/starledger-{spark.sparkContext.applicationId}"


def staging_path(spark: SparkSession) -> str:
    """A new path under the staging root."""
    return f"{_session_folder(spark)}/{uuid.uuid4().hex}"


def clear_staged(spark: SparkSession) -> None:
    """Remove all that this application staged. Frames that read it are of no use afterwards."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(_session_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` once and read it back.

    Cuts lineage: what is computed later reads committed files, so it neither
    repeats the work behind ``df`` nor depends on executors that may be lost,
    and column pruning still reaches the scan.
    """
    path = staging_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
