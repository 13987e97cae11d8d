"""Queries that run streams over the event table to its end."""

from __future__ import annotations

from pyspark.sql import functions as F

from notegraph.plans.notes import ORACLES as NOTES
from notegraph.streaming.access import event_stream, exposure, fold_boosts_stream, run_to_end, windowed_counts


def q_stream_windows(spark, folder):
    counts = windowed_counts(event_stream(spark, folder), "ts", "event_type")
    return run_to_end(counts, "update", ["start", "event_type"]).select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")


def q_stream_exposure(spark, folder):
    return run_to_end(exposure(event_stream(spark, folder), "user_id"), "update", ["user_id"]).select("user_id", "n")


def q_stream_boosts(spark, folder):
    events = event_stream(spark, folder).withColumn("b", F.col("value") / 100.0)
    folded = run_to_end(fold_boosts_stream(events, "user_id", "ts", "b"), "update", ["user_id"])
    return folded.select("user_id", F.round("boost", 6).alias("boost"), F.date_format("updated", "yyyy-MM-dd HH:mm:ss").alias("updated"))


QUERIES = {k: v for k, v in list(globals().items()) if k.startswith("q_")}
ORACLES = {
    "q_stream_windows": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL",
    "q_stream_exposure": "SELECT user_id, count(*) AS n FROM events GROUP BY user_id",
    "q_stream_boosts": NOTES["q_boost_fold"],
}
