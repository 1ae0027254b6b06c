"""The stream of run features gives what the batch gives once the watermark has passed."""

import random
from datetime import datetime, timedelta

from opsloom.operators import ingest
from opsloom.streaming.features import run_features_stream
from opsloom.streaming.medallion import drain

T0 = datetime(2026, 1, 1)
RUNS, PROFILES, TIMINGS = "run_id string, job_id string, end_time timestamp", "run_id string, profiled_at timestamp, left_rows long", "run_id string, time timestamp, setup_s double, execution_s double"


def test_stream_equals_batch(spark, tmp_path):
    rnd = random.Random(1)
    at = lambda: T0 + timedelta(minutes=rnd.randint(0, 1200))
    runs = [(f"r{i}", "j", at()) for i in range(120)]
    timings = [(i, end + timedelta(minutes=rnd.randint(-5, 60)), float(k), k + 1.0) for k, (i, _, end) in enumerate(runs) if k % 3]
    timings += timings[:9]
    profiles = [(i, end + timedelta(minutes=rnd.randint(0, 300)), 10 * k) for k, (i, _, end) in enumerate(runs) if k % 4]
    tables = {"runs": (RUNS, runs), "profiles": (PROFILES, profiles), "timings": (TIMINGS, timings)}
    batch = {k: spark.createDataFrame(rows, ddl) for k, (ddl, rows) in tables.items()}
    for _, rows in tables.values():
        rnd.shuffle(rows)
    out = str(tmp_path / "out")
    for part in range(5):
        for name, (ddl, rows) in tables.items():
            some = rows[part::3] if part < 3 else [{"runs": ("end", "z", T0 + timedelta(days=9 + part)), "profiles": ("none", T0 + timedelta(days=9 + part), 0), "timings": ("none", T0 + timedelta(days=9 + part), 0.0, 0.0)}[name]]
            spark.createDataFrame(some, ddl).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        streams = {k: spark.readStream.schema(ddl).parquet(str(tmp_path / k)) for k, (ddl, _) in tables.items()}
        drain(run_features_stream(streams["runs"], streams["profiles"], streams["timings"], "1 day", "12 hours"), out, str(tmp_path / "c"))
    columns = ["run_id", "job_id", "left_rows", "input_rows", "setup_s", "execution_s"]
    want = ingest.run_features(batch["runs"], batch["profiles"], batch["timings"]).select(columns).collect()
    got = spark.read.parquet(out).filter("job_id = 'j'").select(columns).collect()
    assert len(got) == 120 and sorted(map(tuple, got), key=repr) == sorted(map(tuple, want), key=repr)
