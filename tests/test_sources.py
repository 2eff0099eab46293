"""Files, exports and the keyed store."""

import csv
import glob
import json

import pytest
from pyspark.sql import functions as F

from tidemark import session
from tidemark.operators import snapshots
from tidemark.sources import files, store


def test_scan_sources(spark, tmp_path):
    (tmp_path / "pkg" / "deep").mkdir(parents=True)
    (tmp_path / "a.py").write_text("x = 1\ny = 2\n")
    (tmp_path / "pkg" / "deep" / "b.py").write_text("z = 3\n")
    (tmp_path / "notes.txt").write_text("no source")
    found = {r.source_id.rsplit("/", 1)[1]: r.source for r in files.scan_sources(spark, str(tmp_path)).collect()}
    assert found == {"a.py": "x = 1\ny = 2\n", "b.py": "z = 3\n"}
    one = files.scan_sources(spark, str(tmp_path / "a.py")).collect()
    assert [r.source for r in one] == ["x = 1\ny = 2\n"]


@pytest.fixture
def records(spark):
    rows = [("m1", 0.5, (True, (False, 3))), ("m2", 1.5, (False, (True, 4)))]
    schema = "source_id string, score double, flags struct<secret: boolean, more: struct<eval: boolean, n: int>>"
    return spark.createDataFrame(rows, schema)


def test_csv_equals_flattened_json(records, spark, tmp_path):
    store.write_json(records, str(tmp_path / "json"))
    store.write_csv(records, str(tmp_path / "csv"))
    lines = [json.loads(x) for p in glob.glob(str(tmp_path / "json/part*")) for x in open(p)]
    flat = {
        r["source_id"]: [str(r["score"]), str(r["flags"]["secret"]).lower(),
                         str(r["flags"]["more"]["eval"]).lower(), str(r["flags"]["more"]["n"])]
        for r in lines
    }
    seen = {}
    for path in glob.glob(str(tmp_path / "csv/part*")):
        for row in csv.reader(open(path)):
            if row[0] == "source_id":
                assert row == ["source_id", "score", "flags_secret", "flags_more_eval", "flags_more_n"]
            else:
                seen[row[0]] = row[1:]
    assert seen == flat
    again = spark.read.schema(records.schema).json(str(tmp_path / "json"))
    assert sorted(again.collect()) == sorted(records.collect())


def test_metadata_round_trip(records):
    packed = store.metadata_to_json(records, ["score", "flags"])
    assert packed.columns == ["source_id", "metadata"]
    schema = "score double, flags struct<secret: boolean, more: struct<eval: boolean, n: int>>"
    assert sorted(store.parse_metadata(packed, "metadata", schema).collect()) == sorted(records.collect())


def test_upsert_versions_and_log(spark, tmp_path):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 1, None)], "id string, seq int, v string")
    new = spark.createDataFrame([("b", 2, "new"), ("c", 2, "c"), ("c", 3, None)], "id string, seq int, v string")
    root = str(tmp_path / "store")
    first = store.write_version(old, root, 1)
    merged = store.upsert_latest(store.load_vectors(spark, first), new, ["id"], ["seq"])
    second = store.load_vectors(spark, store.write_version(merged, root, 2))
    assert sorted(tuple(r) for r in second.collect()) == [("a", 1, "x"), ("b", 2, "new"), ("c", 3, None)]
    assert store.load_vectors(spark, first).count() == 2
    for part in (old, new):
        store.append_log(part, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 5
    assert store.lookup_by_id(second, "id", "zz").count() == 0


def test_store_schemas(spark):
    assert len(spark.createDataFrame([], store.VECTOR_SCHEMA).columns) == 5
    assert len(spark.createDataFrame([], store.LOG_SCHEMA).columns) == 4


def test_snapshots(spark):
    base = spark.createDataFrame([("a.py", "1\n2"), ("b.py", "x"), ("c.txt", "q"), ("d.py", None)], "path string, text string")
    target = spark.createDataFrame([("a.py", "1\n3\n3"), ("c.txt", "r"), ("e.py", "new"), ("d.py", None)], "path string, text string")
    found = snapshots.snapshot_diff(base, target, "path", "text").collect()
    assert sorted((r.path, r.change_type, r.new_content) for r in found if r.new_content) == [
        ("a.py", "modified", "1\n3\n3"), ("e.py", "added", "new"),
    ]
    assert [r.path for r in found if r.change_type == "removed"] == ["b.py"]
    lines = snapshots.line_diff(base, target, "path", "text").filter("path = 'a.py'").collect()
    assert sorted((r.line, r.copies) for r in lines) == [("2", -1), ("3", 2)]


def test_drift_ratio(spark):
    base = spark.createDataFrame([("a", 2.0), ("b", 2.0), ("c", 1.0)], "k string, d double")
    target = spark.createDataFrame([("a", 3.0), ("b", 3.01), ("z", 9.0)], "k string, d double")
    got = {r.k: r.drift_detected for r in snapshots.drift(base, target, ["k"], "d").collect()}
    assert got == {"a": False, "b": True}


def test_shared_folder_is_the_configured_one(spark):
    assert session.shared_folder(spark) == spark.sparkContext.getConf().get("spark.checkpoint.dir")
    kept = session.stored(spark.range(5).withColumn("x", F.col("id") * 2), "numbers")
    assert kept.count() == 5 and kept.columns == ["id", "x"]
