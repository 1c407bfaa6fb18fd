"""The batches of the stream queries: no task holds one whole."""

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from codegauge import storage

PARTS = 3


@pytest.mark.parametrize("name,batches", [("stream_resume_state", 4), ("metrics_incremental", 3), ("sample_batches", 3)])
def test_a_batch_has_a_file_per_reading_task(spark, tmp_path, monkeypatch, name, batches):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(PARTS).write.parquet(str(tmp_path / "events.parquet"))
    folders, new_path = {}, storage.new_path
    monkeypatch.setattr(storage, "new_path", lambda spark, kind: folders.setdefault(kind, new_path(spark, kind)))
    spark.conf.set("spark.sql.files.openCostInBytes", str(128 << 20))  # a task per file
    try:
        assert queries()[name](spark, str(tmp_path)).count()
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    read = spark.read.option("recursiveFileLookup", "true").text(folders["arriving"])
    assert read.select(F.input_file_name()).distinct().count() == batches * PARTS
