"""The incident stream gives what the batch gives, in whatever order evaluations arrive."""

import random
from datetime import datetime, timedelta

from opsloom.streaming import lifecycle as L
from opsloom.streaming.medallion import drain

DDL = "tenant_id string, subject string, type string, event_id string, at timestamp, violating boolean"
T0 = datetime(2026, 1, 1)


def plain(rows):
    """One evaluation after the other."""
    out, open_, seen = [], {}, set()
    for *key, i, at, bad in sorted((r for r in rows if r[4] is not None and r[5] is not None), key=lambda r: (r[4], r[3])):
        key = tuple(key)
        if (key, i) in seen:
            continue
        seen.add((key, i))
        if bad:
            first, n = open_.get(key, (i, 0))
            open_[key] = (first, n + 1)
            if n == 0:
                out.append((*key, "opened", i, at, i, 1))
        elif key in open_:
            out.append((*key, "recovered", i, at, *open_.pop(key)))
    return sorted(out)


def evaluations(seed, n=250):
    rnd = random.Random(seed)
    rows = [(f"t{rnd.randint(0, 1)}", f"s{rnd.randint(0, 3)}", rnd.choice(["a", "b"]), f"e{k:04d}", T0 + timedelta(minutes=rnd.randint(0, 50) * 10), rnd.random() < 0.6) for k in range(n)]
    return rows + rows[:20] + [("t0", "s0", "a", "none", None, True), ("t0", "s0", "a", "unknown", T0, None)]


def test_batch(spark):
    rows = evaluations(1)
    assert sorted(map(tuple, L.transitions(spark.createDataFrame(rows, DDL)).collect())) == plain(rows)
    assert L.transitions(spark.createDataFrame([], DDL)).collect() == []


def test_stream_equals_batch(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", L.PROVIDER)
    rows = evaluations(2)
    random.Random(3).shuffle(rows)
    far = [("z", "z", "z", f"end{k}", T0 + timedelta(days=9 + k), False) for k in range(2)]  # moves the watermark past everything else
    src, out = str(tmp_path / "s"), str(tmp_path / "o")
    for part in (rows[:100], rows[100:190], rows[190:], far[:1], far[1:]):
        spark.createDataFrame(part, DDL).coalesce(1).write.mode("append").parquet(src)
        drain(L.transition_stream(spark.readStream.schema(DDL).parquet(src), "2 days"), out, str(tmp_path / "c"))
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == plain(rows)
