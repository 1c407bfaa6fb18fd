"""Schemas of the tables the engine reads and writes."""

from pyspark.sql import types as T

MESSAGE = T.StructType([
    T.StructField("role", T.StringType()),
    T.StructField("content", T.StringType()),
])
MESSAGES = T.ArrayType(MESSAGE)

GENERATION = T.StructType([
    T.StructField("task_id", T.StringType()),
    T.StructField("completion", T.StringType()),
    T.StructField("token_count", T.IntegerType()),
    T.StructField("generation_time", T.DoubleType()),
    T.StructField("throughput", T.DoubleType()),
])

EXECUTION_ERROR = T.StructType([
    T.StructField("error_class", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("traceback", T.StringType()),
])

EXECUTION = T.StructType([
    T.StructField("sandbox_type", T.StringType()),
    T.StructField("stdout", T.StringType()),
    T.StructField("stderr", T.StringType()),
    T.StructField("errors", T.ArrayType(EXECUTION_ERROR)),
    T.StructField("is_valid_python", T.BooleanType()),
    T.StructField("exit_code", T.IntegerType()),
    T.StructField("start_time", T.TimestampType()),
    T.StructField("end_time", T.TimestampType()),
    T.StructField("duration_sec", T.DoubleType()),
    T.StructField("timed_out", T.BooleanType()),
    T.StructField("memory_limit_hit", T.BooleanType()),
    T.StructField("result", T.StringType()),
])

TASK_RESULT = T.StructType([
    T.StructField("model_name", T.StringType()),
    T.StructField("model_id", T.StringType()),
    T.StructField("dataset_name", T.StringType()),
    T.StructField("task_id", T.StringType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("passed", T.BooleanType()),
    T.StructField("pass_rate", T.DoubleType()),
    T.StructField("correct_format", T.BooleanType()),
    T.StructField("extraction_success", T.BooleanType()),
    T.StructField("sandbox_execution_time", T.DoubleType()),
    T.StructField("generation_time", T.DoubleType()),
    T.StructField("token_count", T.IntegerType()),
    T.StructField("throughput", T.DoubleType()),
    T.StructField("error_message", T.StringType()),
    T.StructField("prompt", MESSAGES),
    T.StructField("completion", T.StringType()),
    T.StructField("extracted_code", T.StringType()),
])

DATASET_METRICS = T.StructType([
    T.StructField("dataset_name", T.StringType()),
    T.StructField("pass_rate", T.DoubleType()),
    T.StructField("format_success_rate", T.DoubleType()),
    T.StructField("extraction_success_rate", T.DoubleType()),
    T.StructField("avg_sandbox_execution_time", T.DoubleType()),
    T.StructField("total_tokens", T.LongType()),
    T.StructField("avg_tokens", T.DoubleType()),
    T.StructField("completed_tasks", T.LongType()),
])

LOG_RECORD = T.StructType([
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("level", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("function", T.StringType()),
    T.StructField("line", T.IntegerType()),
    T.StructField("message", T.StringType()),
    T.StructField("exc_info", T.StringType()),
    T.StructField("stack_info", T.StringType()),
])
