"""Session settings the engine relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    # result time stamps are UTC
    "spark.sql.session.timeZone": "UTC",
    # run-time plans: joins by real sizes, split of skewed partitions
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Python keeps the last of duplicate JSON keys
    "spark.sql.variant.allowDuplicateKeys": "true",
    # scripts may be long: keep Arrow batches of whole texts small
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings to a session the caller made."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark
