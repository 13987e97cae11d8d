"""Structured Streaming over access events: windowed counts, propensities, boosts as keyed state."""

from __future__ import annotations

from collections.abc import Iterator
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notegraph.session import ensure_checkpoint_dir


def event_stream(spark: SparkSession, folder: str, table: str = "events", files: int | None = None) -> DataFrame:
    """A table's files as a stream, ``files`` of them a batch, the oldest first; the schema is that of the files."""
    path = f"{folder}/{table}.parquet"
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    if spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(spark._jvm.org.apache.hadoop.fs.Path(path)).isFile():
        return reader.option("pathGlobFilter", f"{table}.parquet").parquet(folder)
    return reader.parquet(path)


def windowed_counts(events: DataFrame, at: str, by: str, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Rows per tumbling window and key; events later than ``late`` behind the newest are dropped."""
    rows = events.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late)
    return rows.groupBy(F.window("_at", window).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), by, "n")


def exposure(events: DataFrame, title: str) -> DataFrame:
    """Running occurrences per title, for propensities (divide by the number of events)."""
    return events.groupBy(title).agg(F.count(F.lit(1)).alias("n"))


def fold_boosts_stream(events: DataFrame, key: str, at: str, boost: str, rate: float = 0.1) -> DataFrame:
    """``(key, boost, updated)`` after each batch: ``min(1, old x exp(-rate x days) + new)`` as state per key.

    Events of a batch are folded in order of time; an event older than the state is added without decay and leaves the
    state's time as it is. Null keys, times and boosts and negative boosts are dropped.
    """
    rows = events.where(F.col(key).isNotNull() & F.col(at).isNotNull() & (F.col(boost) >= 0))
    rows = rows.select(F.col(key).alias("k"), F.unix_micros(F.col(at).cast("timestamp")).alias("t"), F.col(boost).cast("double").alias("b"))
    kind = events.schema[key].dataType.simpleString()

    def fold(k, batches: Iterator, state) -> Iterator:
        import math

        import pandas as pd

        value, last = state.get if state.exists else (0.0, None)
        for t, b in sorted(x for pdf in batches for x in zip(pdf["t"], pdf["b"])):
            days = max(0, t - last) / 86_400e6 if last is not None else 0.0
            value, last = min(1.0, value * math.exp(-rate * days) + b), int(t) if last is None else max(last, int(t))
        state.update((value, last))
        yield pd.DataFrame({"k": [k[0]], "boost": [value], "updated": [last]})

    out = rows.groupBy("k").applyInPandasWithState(fold, f"k {kind}, boost double, updated bigint", "boost double, updated bigint", "update", "NoTimeout")
    return out.select(F.col("k").alias(key), "boost", F.timestamp_micros("updated").alias("updated"))


def run_to_end(stream: DataFrame, mode: str, key: list[str]) -> DataFrame:
    """Runs a stream over what is there and returns the last row of each key, read from the shared folder.

    Batches are written apart, so a batch that is run again overwrites itself.
    """
    spark = stream.sparkSession
    ensure_checkpoint_dir(spark)
    base = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/stream-{uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.option("basePath", f"{base}/out").parquet(f"{base}/out/*").drop("batch")
    names = [c for c in rows.columns if c not in (*key, "_batch")]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*names), "_batch").alias("r")).select(*key, "r.*")
