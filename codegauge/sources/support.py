"""Module maps, run logs and input files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codegauge.functions.execution import is_binary
from codegauge.schemas import LOG_RECORD
from codegauge.storage import path_exists


def read_module_map(spark: SparkSession, path: str) -> DataFrame:
    """``module, package`` from a JSON object's ``mapping`` key; empty on any error."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], "module string, package string")
    whole = spark.read.text(path, wholetext=True)
    parsed = F.from_json("value", "mapping map<string,string>")
    return whole.select(F.explode(parsed["mapping"]).alias("module", "package"))


def parse_logs(lines: DataFrame, column: str = "value") -> DataFrame:
    """Core log fields as typed columns, and the whole record as a variant.

    Dynamic extra fields are read with ``log_field``.  Lines that are no JSON
    object have null fields.
    """
    record = F.try_parse_json(column)
    core = [
        F.try_variant_get("record", f"$.{f.name}", f.dataType.simpleString()).alias(f.name)
        for f in LOG_RECORD.fields
    ]
    return lines.withColumn("record", record).select(*lines.columns, *core, "record")


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    return parse_logs(spark.read.text(path)).drop("value")


def log_field(name: str, data_type: str) -> Column:
    """An extra field of a parsed log record."""
    return F.try_variant_get("record", f"$.{name}", data_type)


def classify_files(files: DataFrame) -> DataFrame:
    """Binary or text by a zero byte at the start; text only if valid UTF-8."""
    text = F.col("content").cast("string")
    readable = F.is_valid_utf8(text)
    return files.withColumn("is_binary", is_binary(F.col("content"))).withColumn(
        "text", F.when(~F.col("is_binary") & readable, text)
    )


def read_input_files(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").load(path)
    name = F.substring_index("path", "/", -1)
    return classify_files(files.select("path", name.alias("name"), "length", "content"))
