"""Streams over several batches: state goes on, late events are dropped or added without decay."""

import math
import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from notegraph.streaming.access import event_stream, exposure, fold_boosts_stream, run_to_end, windowed_counts

START = datetime(2024, 1, 1)
#: Hours after the start, user, value: one list a file. The last file begins with an event a day late; Spark drops by
#: the watermark before that of the batch itself, hence the file between.
FILES = [
    [(1, 1, 0.2), (3, 2, 0.9), (5, 1, 0.1)],
    [(30, 1, 0.4), (31, 2, 0.8), (32, 3, None)],
    [(33, 2, 0.1)],
    [(10, 1, 0.3), (80, 1, 0.2), (81, 3, 0.5)],
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("stream")
    for i, rows in enumerate(FILES):
        df = spark.createDataFrame([(START + timedelta(hours=h), u, v) for h, u, v in rows], "ts timestamp, user_id bigint, value double")
        df.coalesce(1).write.mode("append").parquet(f"{base}/events.parquet")
        for name in os.listdir(base / "events.parquet"):
            path = base / "events.parquet" / name
            if os.path.getmtime(path) > 2_000_000:
                os.utime(path, (1_000_000 + i * 1000, 1_000_000 + i * 1000))
    return str(base)


def test_counts_drop_what_comes_behind_the_watermark(spark, folder):
    counts = run_to_end(windowed_counts(event_stream(spark, folder, files=1), "ts", "user_id"), "update", ["start", "user_id"])
    found = {((r.start - START).days, r.user_id): r.n for r in counts.collect()}
    assert found == {(0, 1): 2, (0, 2): 1, (1, 1): 1, (1, 2): 2, (1, 3): 1, (3, 1): 1, (3, 3): 1}
    late = run_to_end(windowed_counts(event_stream(spark, folder, files=1), "ts", "user_id", late="5 days"), "update", ["start", "user_id"])
    assert {((r.start - START).days, r.user_id): r.n for r in late.collect()}[0, 1] == 3


def test_exposure_goes_on_over_batches(spark, folder):
    found = {r.user_id: r.n for r in run_to_end(exposure(event_stream(spark, folder, files=1), "user_id"), "update", ["user_id"]).collect()}
    assert found == {1: 5, 2: 3, 3: 2}


def test_boosts_are_state_over_batches(spark, folder):
    folded = run_to_end(fold_boosts_stream(event_stream(spark, folder, files=1), "user_id", "ts", "value"), "update", ["user_id"])
    found = {r.user_id: r.boost for r in folded.withColumn("updated", F.col("updated")).collect()}
    state = {}
    for rows in FILES:
        for h, u, v in sorted(r for r in rows if r[2] is not None):
            old, last = state.get(u, (0.0, h))
            state[u] = min(1.0, old * math.exp(-0.1 * max(0, h - last) / 24) + v), max(last, h)
    assert found == pytest.approx({u: v for u, (v, _) in state.items()})
