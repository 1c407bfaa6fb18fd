"""Task results as JSON lines: append, read, newest run."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codegauge.schemas import TASK_RESULT
from codegauge.storage import list_paths, path_exists

RUN_COLUMNS = ["model_id", "run_ts"]
STORED_RESULT = T.StructType([*TASK_RESULT.fields, T.StructField("run_ts", T.StringType())])


def append_results(results: DataFrame, path: str, part: str | None = None) -> None:
    """Append rows in a folder of their own, in it one folder per model and run.

    A run is read by pruning.  Rows are rebalanced by run before they are written, so
    small runs make one file and large ones are split.  A given ``part`` replaces what
    was written under that name; other parts are never touched.
    """
    mode = "errorifexists" if part is None else "overwrite"
    folder = f"{path}/part={part or uuid.uuid4().hex}"
    results.hint("rebalance", *RUN_COLUMNS).write.mode(mode).partitionBy(*RUN_COLUMNS).json(folder)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """All result rows; a missing path gives no rows."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], STORED_RESULT)
    return spark.read.schema(STORED_RESULT).json(path).select(*STORED_RESULT.names)


def newest_run(spark: SparkSession, path: str, model_id: str) -> str | None:
    """Run stamp of a model's newest run, from the folder names alone."""
    names = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
    model_folder = f"{path}/part=*/model_id={names.escapePathName(model_id)}"
    runs = [folder.split("run_ts=", 1)[1] for folder in list_paths(spark, f"{model_folder}/run_ts=*")]
    return max((names.unescapePathName(run) for run in runs), default=None)


def read_run(spark: SparkSession, path: str, model_id: str, run_ts: str | None) -> DataFrame:
    """Rows of one run; only that run's folder is scanned."""
    rows = read_results(spark, path)
    return rows.where((F.col("model_id") == model_id) & (F.col("run_ts") == F.lit(run_ts)))


def read_latest_run(spark: SparkSession, path: str, model_id: str) -> DataFrame:
    """Rows of one model's newest run."""
    return read_run(spark, path, model_id, newest_run(spark, path, model_id))
