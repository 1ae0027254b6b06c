"""Durable upserts: replays, killed writers, races, and what is left alone."""

import random
from pathlib import Path

import pytest

from opsloom.sources import upserts as U

DDL = "k string, at long, v string"


def rows_of(spark, path):
    return sorted(map(tuple, U.current(spark, path, DDL).collect()), key=repr)


def test_against_a_dictionary(spark, tmp_path):
    rnd, path, want = random.Random(3), str(tmp_path / "t"), {}
    assert rows_of(spark, path) == []
    for batch in range(4):
        rows = [(rnd.choice([None, *map(str, range(30))]), rnd.randint(0, 50), f"v{batch}-{i}") for i in range(25)]
        for k in {r[0] for r in rows}:  # one row of a key and instant
            best = max((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2]))
            if k not in want or best[1] >= want[k][1]:
                want[k] = best
        df = spark.createDataFrame(rows, DDL)
        assert U.upsert(df, path, "k", "at", batch, buckets=8)
        assert not U.upsert(df, path, "k", "at", batch, buckets=8)  # a replay
        assert rows_of(spark, path) == sorted(want.values(), key=repr)


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    path = str(tmp_path / "t")
    U.upsert(spark.range(200).selectExpr("cast(id as string) k", "0L at", "'a' v"), path, "k", "at", 0, buckets=16)
    before = U.pointer(spark, path)["buckets"]
    U.upsert(spark.createDataFrame([("7", 1, "b")], DDL), path, "k", "at", 1, buckets=16)
    after = U.pointer(spark, path)["buckets"]
    assert sum(before[b] != after[b] for b in before) == 1 and len(rows_of(spark, path)) == 200 and ("7", 1, "b") in rows_of(spark, path)
    assert U.swept(spark, path, keep=1) == 0 and len(rows_of(spark, path)) == 200


def test_insert_only_keeps_what_is_there(spark, tmp_path):
    path = str(tmp_path / "t")
    U.upsert(spark.createDataFrame([("a", 1, "old")], DDL), path, "k", "at", 0, buckets=4)
    U.upsert(spark.createDataFrame([("a", 9, "new"), ("b", 1, "new")], DDL), path, "k", "at", 1, insert_only=True, buckets=4)
    assert rows_of(spark, path) == [("a", 1, "old"), ("b", 1, "new")]


def test_a_killed_writer_leaves_the_table_right(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    U.upsert(spark.createDataFrame([("a", 1, "old")], DDL), path, "k", "at", 0, buckets=4)
    real = U.publish
    monkeypatch.setattr(U, "publish", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
    with pytest.raises(KeyboardInterrupt):
        U.upsert(spark.createDataFrame([("a", 2, "lost")], DDL), path, "k", "at", 1, buckets=4)
    monkeypatch.setattr(U, "publish", real)
    assert rows_of(spark, path) == [("a", 1, "old")]
    assert U.upsert(spark.createDataFrame([("a", 2, "new")], DDL), path, "k", "at", 1, buckets=4)  # the batch comes again
    assert rows_of(spark, path) == [("a", 2, "new")]
    assert U.swept(spark, path, keep=1) == 2 and rows_of(spark, path) == [("a", 2, "new")]


def test_two_writers_cannot_publish_the_same_number(spark, tmp_path):
    path = str(tmp_path / "t")
    U.upsert(spark.createDataFrame([("a", 1, "x")], DDL), path, "k", "at", 0, buckets=4)
    late = U.pointer(spark, path) | {"number": 1}
    with pytest.raises(RuntimeError):
        U.publish(spark, path, late)
    assert not [p for p in Path(path, U.POINTERS).iterdir() if p.name.startswith(".") and not p.name.endswith(".crc")]


def test_stream_into_a_table(spark, tmp_path):
    src, path, cp = str(tmp_path / "s"), str(tmp_path / "t"), str(tmp_path / "c")
    for k in range(3):
        spark.createDataFrame([("a", k, f"v{k}"), (f"b{k}", k, "x")], DDL).write.mode("append").parquet(src)
        U.stream_into(spark.readStream.schema(DDL).parquet(src), path, "k", "at", cp, buckets=4)
    assert rows_of(spark, path) == [("a", 2, "v2"), ("b0", 0, "x"), ("b1", 1, "x"), ("b2", 2, "x")]
    assert U.pointer(spark, path)["last"] == {"stream": 2}
