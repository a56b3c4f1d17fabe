"""Streams of files run to their end, with late and repeated rows; inputs of which only changed files are read again."""

import shutil

import pytest
from pyspark.sql import functions as F

from panelspark.sources import tables
from panelspark.streaming import streams


def test_late_rows_are_left_out_and_counted(spark, tmp_path):
    day = lambda d, n: spark.createDataFrame([(i % 3, f"2024-01-{d:02d} 0{i % 9}:00:00", float(i)) for i in range(n)], "u int, ts string, v double").withColumn("ts", F.col("ts").cast("timestamp"))
    source, sink = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    files = streams.arrivals([day(1, 30), day(20, 30), day(21, 30), day(1, 30).unionAll(day(19, 30)), day(28, 30)], source, files=2)
    job = lambda rows: streams.stream_trailing(rows, "u", "ts", "1 day", "2 days", [F.count("*").alias("n")])
    schema = day(1, 1).schema
    rows, late = streams.landed(spark, source, schema, job, sink, files)
    got = {(r.u, r.start.day): r.n for r in rows.collect()}
    assert got == {(u, d): 10 for u in range(3) for d in (1, 19, 20, 21)}  # day 1 again: its windows were out; day 28 isn't over
    assert late > 0
    streams.arrivals([day(31, 30)], source, files=2, first=5)
    rows, _ = streams.landed(spark, source, schema, job, sink, files)  # goes on where it was
    got = {(r.u, r.start.day): r.n for r in rows.collect()}
    assert got[0, 28] == 10 and len(got) == 15


def test_repeats_come_out_once(spark, tmp_path):
    rows = spark.range(40).select((F.col("id") % 4).alias("k"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") % 8).alias("ts"))
    source = f"file://{tmp_path}/in"
    files = streams.arrivals([rows, rows, rows], source, files=2)
    got, _ = streams.landed(spark, source, rows.schema, lambda r: streams.stream_dedupe(r, ["k", "ts"], "ts", "1 hour"), f"file://{tmp_path}/out", files)
    assert got.count() == rows.distinct().count()


@pytest.fixture
def inputs(tmp_path):
    root = tmp_path / "files"
    root.mkdir()
    for name, body in {"a b.csv": "k,v\n1,x\n2,y\n", "c=d.csv": "k,v\n3,z\n", "copy.csv": "k,v\n3,z\n", "empty.csv": "k,v\n"}.items():
        (root / name).write_text(body)
    return root


def stage(spark, root, path):
    seen = []

    def read(paths):
        seen.extend(p.rsplit("/", 1)[-1] for p in paths)
        return spark.read.csv(paths, header=True)

    rows, n = tables.staged(spark, f"file://{root}", f"file://{path}", read, {"k": F.col("k").cast("int"), "v": F.upper("v")}, "k int, v string", "*.csv")
    assert n == len(seen)
    return sorted(map(tuple, rows.collect())), sorted(seen)


def test_only_changed_files_are_read_again(spark, tmp_path, inputs):
    path = tmp_path / "staged"
    rows, seen = stage(spark, inputs, path)
    assert rows == [(1, "X"), (2, "Y"), (3, "Z"), (3, "Z")] and len(seen) == 3  # copies are parsed once, count each
    assert stage(spark, inputs, path) == (rows, [])
    (inputs / "c=d.csv").write_text("k,v\n4,w\n")
    (inputs / "a b.csv").unlink()
    rows, seen = stage(spark, inputs, path)
    assert rows == [(3, "Z"), (4, "W")] and len(seen) == 1 and seen[0].startswith("c")
    (inputs / "again.csv").write_text("k,v\n1,x\n2,y\n")  # content that was there before
    assert stage(spark, inputs, path)[0] == [(1, "X"), (2, "Y"), (3, "Z"), (4, "W")]


def test_a_run_that_broke_off_is_run_again(spark, tmp_path, inputs):
    path = tmp_path / "staged"
    rows, _ = stage(spark, inputs, path)
    (inputs / "new.csv").write_text("k,v\n9,n\n")
    broken = path / "manifest" / "version=2"
    shutil.copytree(path / "manifest" / "version=1", broken)
    (broken / "_SUCCESS").unlink()  # a manifest without its mark doesn't count
    again, seen = stage(spark, inputs, path)
    assert again == sorted([*rows, (9, "N")]) and seen == ["new.csv"]


def test_nothing_to_stage(spark, tmp_path):
    (tmp_path / "none").mkdir()
    assert stage(spark, tmp_path / "none", tmp_path / "staged") == ([], [])
