import hashlib
import json
import random

import pytest

from holdfast.operators.contracts import enforce
from holdfast.sources import io


def test_delimited_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "x"), (2, None)], "a int, b string")
    path = str(tmp_path / "out")
    io.write_table(df, path, "csv.gz", sep="\t")
    assert io.header(spark, path, "\t") == ["a", "b"]
    back = io.read_table(spark, path, "a int, b string", "\t", ["a"])
    assert sorted(r["a"] for r in back.collect()) == [1, 2]
    with pytest.raises(Exception):
        io.write_table(df, path, "csv.gz")


def test_mapping_and_hash(spark, tmp_path):
    path = tmp_path / "map.json"
    path.write_text(json.dumps({"a": "x", "b": "y"}))
    assert {(r["key"], r["value"]) for r in io.read_mapping(spark, str(path)).collect()} == {("a", "x"), ("b", "y")}
    row = io.file_hashes(spark, str(tmp_path), ["map.json"]).first()
    assert row["file"] == "map.json" and row["sha256"] == hashlib.sha256(path.read_bytes()).hexdigest()


def test_file_hashes_by_ranges(spark, tmp_path):
    """Files of any length, one of them in a folder; an empty one has no row."""
    (tmp_path / "part").mkdir()
    content = {"a.bin": bytes(range(256)) * 10, "empty.bin": b"", "part/b.bin": b"x" * 1000}
    for name, data in content.items():
        (tmp_path / name).write_bytes(data)
    got = {r["file"]: r for r in io.file_hashes(spark, str(tmp_path), ["a.bin", "empty.bin", "part"], 1000).collect()}
    assert set(got) == set(content) - {"empty.bin"}
    del content["empty.bin"]
    for name, data in content.items():
        ranges = [hashlib.sha256(data[i : i + 1000]).hexdigest() for i in range(0, max(len(data), 1), 1000)]
        assert (got[name]["bytes"], got[name]["sha256"]) == (len(data), hashlib.sha256(data).hexdigest())
        assert got[name]["range_hashes"] == ranges and got[name]["root"] == hashlib.sha256("\n".join(ranges).encode()).hexdigest()


def test_vector_lookup_reports_missing(spark):
    entities = spark.createDataFrame([(1,), (2,)], "entity int")
    vectors = spark.createDataFrame([(1, [0.5])], "entity int, vector array<double>")
    found, check = io.lookup_vectors(entities, vectors, "entity", "vector")
    assert [r["entity"] for r in found.collect()] == [1]
    with pytest.raises(ValueError):
        enforce(check)


def test_union_runs_fills_missing_columns(spark):
    a = spark.createDataFrame([(1,)], "x int")
    b = spark.createDataFrame([(2, 3)], "x int, y int")
    assert {tuple(r) for r in io.union_runs({"a": a, "b": b}).select("run_tag", "x", "y").collect()} == {("a", 1, None), ("b", 2, 3)}


def test_files_are_hashed_piece_by_piece(spark, tmp_path):
    """Line feeds, marks and splits come back as they were, and a plan without packed files holds no file as one row."""
    feed = bytes(random.Random(1).randrange(256) for _ in range(300_000))
    content = {
        "a.bin": feed, "feeds.bin": b"\n\n\n", "mark.bin": b"\xef\xbb\xbfa\nb\n", "mark2.bin": b"\xef\xbb\xbfa\r\nb",
        "two +words%.bin": b"\r\n" + feed[:5000] + b"\n\n", "packed.gz": b"no gzip at all\n", "none.bin": b"z" * 5000,
    }
    for name, data in content.items():
        (tmp_path / name).write_bytes(data)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        df = io.file_hashes(spark, str(tmp_path), ["."], 1000)
        got = {r["file"]: r for r in df.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert "MapInArrow" in df._jdf.queryExecution().executedPlan().toString()
    assert set(got) == set(content)
    for name, r in got.items():
        data = content[name]
        ranges = [hashlib.sha256(data[i : i + 1000]).hexdigest() for i in range(0, len(data), 1000)]
        assert (r["bytes"], r["sha256"], r["range_hashes"]) == (len(data), hashlib.sha256(data).hexdigest(), ranges)
