"""Code extraction and message handling."""

from __future__ import annotations

from pyspark.sql import functions as F

from codegauge.functions.extract import extract_code, has_python_fence
from codegauge.functions.text import completion_text, first_line, last_line, strip
from workload.sqltext import EXTRACTED, stripped
from workload.views import table, view, with_views


def extract_last(spark, sf_dir):
    df = view(spark, sf_dir, "fx_completions")
    return df.select("sample_id", extract_code(F.col("completion")).alias("x")).select(
        "sample_id", "x.code", "x.correct_format"
    )


def extract_all(spark, sf_dir):
    df = view(spark, sf_dir, "fx_completions")
    return df.select("sample_id", extract_code(F.col("completion"), "all").alias("x")).select(
        "sample_id", "x.code", "x.correct_format"
    )


def format_rate(spark, sf_dir):
    """Share of completions per prompt with code, and in the asked format."""
    df = view(spark, sf_dir, "fx_completions")
    code = extract_code(F.col("completion"))["code"]
    return (
        df.select("prompt_id", code.isNotNull().alias("has_code"),
                  has_python_fence(F.col("completion")).alias("well_formed"))
        .groupBy("prompt_id")
        .agg(
            F.count(F.lit(1)).alias("n_samples"),
            F.avg(F.col("has_code").cast("double")).alias("extraction_rate"),
            F.avg(F.col("well_formed").cast("double")).alias("format_rate"),
        )
    )


def completion_messages(spark, sf_dir):
    """Completions as chat messages: the last message counts, none is empty."""
    df = view(spark, sf_dir, "fx_completions")
    message = lambda text: F.struct(F.lit("assistant").alias("role"), text.alias("content"))
    messages = (
        F.when(F.col("sample_idx") % 3 == 0, F.array(message(F.lit("draft")), message(F.col("completion"))))
        .when(F.col("sample_idx") % 3 == 1, F.array(message(F.col("completion"))))
        .otherwise(F.array().cast("array<struct<role:string,content:string>>"))
    )
    text = completion_text(F.col("messages"), is_message_list=True)
    return df.select("sample_id", messages.alias("messages")).select(
        "sample_id", F.md5(text).alias("text_md5"), F.length(text).cast("bigint").alias("n_chars")
    )


def strip_texts(spark, sf_dir):
    """White space of any kind off both ends of whole texts; first and last line."""
    text = F.concat(F.lit(" \t\xa0\n\x0b"), F.col("text"), F.lit("\r\n \x0c\n"))
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        "doc_id", F.md5(strip(text)).alias("text_md5"), F.md5(first_line(text)).alias("first_md5"),
        F.md5(last_line(text)).alias("last_md5"),
    )


QUERIES = {
    "strip_texts": strip_texts,
    "extract_last": extract_last,
    "extract_all": extract_all,
    "format_rate": format_rate,
    "completion_messages": completion_messages,
}

ORACLES = {
    "strip_texts": f"""
        WITH stripped AS (SELECT doc_id, {stripped('text')} AS text FROM documents)
        SELECT doc_id, md5(text) AS text_md5, md5(string_split(text, chr(10))[1]) AS first_md5,
          md5(list_last(string_split(text, chr(10)))) AS last_md5
        FROM stripped""",
    "extract_last": with_views(
        ["fx_completions"], f"+{EXTRACTED} SELECT sample_id, code, correct_format FROM extracted"
    ),
    "extract_all": with_views(
        ["fx_completions"],
        f"+{EXTRACTED} SELECT sample_id, all_code AS code, correct_format FROM extracted",
    ),
    "format_rate": with_views(
        ["fx_completions"],
        f"""+{EXTRACTED}
        SELECT prompt_id, count(*) AS n_samples,
          avg(CASE WHEN code IS NOT NULL THEN 1.0E0 ELSE 0.0E0 END) AS extraction_rate,
          avg(CASE WHEN correct_format THEN 1.0E0 ELSE 0.0E0 END) AS format_rate
        FROM extracted GROUP BY prompt_id""",
    ),
    "completion_messages": with_views(
        ["fx_completions"],
        """+ texts AS (
          SELECT sample_id, CASE WHEN sample_idx % 3 = 2 THEN '' ELSE completion END AS text
          FROM fx_completions)
        SELECT sample_id, md5(text) AS text_md5, length(text) AS n_chars FROM texts""",
    ),
}
