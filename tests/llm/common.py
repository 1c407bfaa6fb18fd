"""Shared helpers of the corpus tests."""

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, first_id=0, lang="en"):
    """One document per text; texts may be null."""
    rows = [(first_id + k, t, lang, "s", None if t is None else len(t)) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCUMENT)


def save(df, tmp_path, name="documents"):
    """Write a table the way queries read it; returns the folder."""
    df.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)
