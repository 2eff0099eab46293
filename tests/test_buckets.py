"""The store in buckets: latest rows, batches that run again, and what a batch reads and writes."""

import glob
import os

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from tidemark.streaming.buckets import read_buckets, upsert_buckets

SCHEMA = "k string, seq int, v string"


def rows(spark, *data):
    return spark.createDataFrame(list(data), SCHEMA)


def content(spark, folder):
    return sorted(map(tuple, read_buckets(spark, folder, rows(spark).schema).collect()), key=repr)


def files(folder):
    return {p: os.stat(p).st_mtime_ns for p in glob.glob(f"{folder}/store/*/part-*")}


def test_later_rows_win(spark, tmp_path):
    folder = str(tmp_path)
    assert content(spark, folder) == []
    upsert_buckets(rows(spark, ("a", 1, "x"), ("b", 5, "y"), ("a", 2, "z"), (None, 1, "n")), 0, folder, ["k"], ["seq"], 8)
    upsert_buckets(rows(spark, ("b", 4, "late"), ("c", 1, "new"), (None, 2, "m")), 1, folder, ["k"], ["seq"], 8)
    upsert_buckets(rows(spark), 2, folder, ["k"], ["seq"], 8)
    assert content(spark, folder) == [("a", 2, "z"), ("b", 5, "y"), ("c", 1, "new"), (None, 2, "m")]


def test_a_batch_leaves_other_buckets_alone(spark, tmp_path):
    folder = str(tmp_path)
    many = spark.range(400).select(F.col("id").cast("string").alias("k"), F.lit(1).alias("seq"), F.lit("old").alias("v"))
    upsert_buckets(many, 0, folder, ["k"], ["seq"], 32)
    before = files(folder)
    touched = upsert_buckets(rows(spark, ("7", 2, "new")), 1, folder, ["k"], ["seq"], 32)
    after = files(folder)
    assert len(touched) == 1
    mine = {p for p in [*before, *after] if f"_bucket={touched[0]}/" in p}
    assert {p: t for p, t in before.items() if p not in mine} == {p: t for p, t in after.items() if p not in mine}
    # what a batch reads follows its buckets
    plan = read_buckets(spark, folder, many.schema, touched)._jdf.queryExecution().executedPlan().toString()
    assert "_bucket#" in plan.split("PartitionFilters: ")[1].split("]")[0] and f"= {touched[0]})" in plan
    assert len(content(spark, folder)) == 400 and ("7", 2, "new") in content(spark, folder)


@pytest.mark.parametrize("fails_at", ["aside", "notes", "store"])
def test_a_batch_that_runs_again(spark, tmp_path, monkeypatch, fails_at):
    folder = str(tmp_path)
    upsert_buckets(rows(spark, ("a", 1, "x"), ("b", 1, "y")), 0, folder, ["k"], ["seq"], 1)
    batch = rows(spark, ("a", 2, "z"), ("c", 1, "w"))
    write = DataFrameWriter.parquet

    def failing(self, path, *more, **named):
        if f"/{fails_at}" in path:
            if fails_at == "store":  # buckets that are gone half way
                for p in glob.glob(f"{folder}/store/*/part-*"):
                    os.truncate(p, 0)
            raise OSError("lost")
        return write(self, path, *more, **named)

    monkeypatch.setattr(DataFrameWriter, "parquet", failing)
    with pytest.raises(OSError):
        upsert_buckets(batch, 1, folder, ["k"], ["seq"], 1)
    monkeypatch.undo()
    for _ in range(2):
        upsert_buckets(batch, 1, folder, ["k"], ["seq"], 1)
        assert content(spark, folder) == [("a", 2, "z"), ("b", 1, "y"), ("c", 1, "w")]
