"""Where intermediate tables live, and how a job reuses them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: the cluster's ``spark.checkpoint.dir``.

    Only a local master without that setting gets a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="codegauge-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def list_paths(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a glob; none if there is nothing."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    fs = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    return [status.getPath().toString() for status in fs.globStatus(hadoop_path) or []]


def path_exists(spark: SparkSession, path: str) -> bool:
    """True if the path, or any file of the glob, exists."""
    return bool(list_paths(spark, path))


_STAGED: list[str] = []


def stage(df: DataFrame, name: str) -> DataFrame:
    """Run ``df`` once, keep it as a table in the shared folder, read it back.

    Used where a costly result is read twice: lost executors then cost a re-read
    and not a second run of user scripts.  ``clear_staged`` deletes what is no
    longer needed.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.mode("errorifexists").parquet(path)
    _STAGED.append(path)
    return spark.read.schema(df.schema).parquet(path)


def staged_paths() -> list[str]:
    """Tables this process staged and has not deleted, oldest first."""
    return list(_STAGED)


def clear_staged(spark: SparkSession, paths: list[str] | None = None) -> int:
    """Delete staged tables (all, or those named), after their last reader is done."""
    deleted = 0
    for name in staged_paths() if paths is None else paths:
        if name in _STAGED:
            _STAGED.remove(name)
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        deleted += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return deleted


def materialise(df: DataFrame, path: str) -> DataFrame:
    """Reuse the finished table at ``path``, or write it there first.

    Only a table with its ``_SUCCESS`` mark counts as finished.  A folder left by
    a broken run is an error and is not overwritten.
    """
    spark = df.sparkSession
    if not path_exists(spark, f"{path}/_SUCCESS"):
        df.write.mode("errorifexists").parquet(path)
    return spark.read.parquet(path)


def sample_table_path(root: str, seed: int, num_samples: int) -> str:
    return f"{root.rstrip('/')}/seed_{seed}_samples_{num_samples}"
