"""Skew-safe building blocks: hot keys with a proven bound, salted joins, ranks without one task per group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: A key is hot when it holds more than this share of the rows, so there are fewer than 1 / share hot keys.
HOT_SHARE = 0.002
#: ... and at least this many rows: below it one task copes.
HOT_ROWS = 200_000


def hot_keys(df: DataFrame, key: str, share: float = HOT_SHARE, rows: int = HOT_ROWS) -> list:
    """The keys that hold over ``share`` of the rows and over ``rows`` rows: at most ``1 / share`` of them.

    One pass with map-side counts; only hot keys reach the driver, so what is collected is bounded by construction.
    Null keys are never hot. An empty table has none.
    """
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > rows)
    found = counts.orderBy(F.desc("_n")).limit(int(1 / share)).collect()
    if not found:
        return []
    total = df.count()
    return [row[0] for row in found if row[1] > share * total]


def salt(key: Column, hot: list, salts: int, spread: Column) -> Column:
    """0 for ordinary keys, a number below ``salts`` from the hash of ``spread`` for hot ones."""
    if not hot:
        return F.lit(0)
    return F.when(key.isin(hot), F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")).otherwise(F.lit(0))


def salted_join(left: DataFrame, right: DataFrame, key: str, hot: list, spread: Column, how: str = "inner", salts: int = 64) -> DataFrame:
    """Equi-join on ``key`` where a hot key's rows of ``left`` are spread over ``salts`` tasks.

    ``right`` should have few rows per key (at best one); only its rows of hot keys are repeated ``salts`` times.
    """
    if not hot:
        return left.join(right, key, how)
    lefts = left.withColumn("_salt", salt(F.col(key), hot, salts, spread))
    every = F.when(F.col(key).isin(hot), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    rights = right.withColumn("_salt", F.explode(every))
    return lefts.join(rights, [key, "_salt"], how).drop("_salt")


def spread_rank(df: DataFrame, by: list[str], value: str, out: str, buckets: int = 256) -> DataFrame:
    """Competition rank (1, 1, 3, ...) of ``value`` descending within ``by``, without one task per group.

    For groups too large for a window in one task. Equal values are counted before anything is ordered; the distinct
    values of a group are cut into ``buckets`` ranges at approximate quantiles, ranked inside their range, and lifted
    by the number of rows in the ranges above. Exact whatever the quantiles are. Null values get a null rank.
    """
    given = df.where(F.col(value).isNotNull())
    counts = given.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    marks = [i / buckets for i in range(1, buckets)]
    bounds = counts.groupBy(*by).agg(F.array_distinct(F.percentile_approx(value, marks, 10_000)).alias("_bounds"))
    placed = counts.join(bounds, by).withColumn("_bucket", F.size(F.filter("_bounds", lambda b: b > F.col(value)))).drop("_bounds")
    above = W.partitionBy(*by).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    totals = placed.groupBy(*by, "_bucket").agg(F.sum("_n").alias("_total")).withColumn("_above", F.coalesce(F.sum("_total").over(above), F.lit(0))).drop("_total")
    inside = W.partitionBy(*by, "_bucket").orderBy(F.desc(value)).rowsBetween(W.unboundedPreceding, -1)
    ranks = placed.withColumn("_before", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(totals, [*by, "_bucket"])
    ranks = ranks.select(*by, value, (F.lit(1) + F.col("_above") + F.col("_before")).alias(out))
    return df.join(ranks, [*by, value], "left")


def spread_row_number(df: DataFrame, by: str, order: Column, out: str, salts: int = 256) -> DataFrame:
    """A dense 1-based number of the rows within ``by``, without one task per group.

    The rows of a key are spread over ``salts`` by the hash of ``order``; they are numbered in their salt and lifted by
    the counts of the salts before, so any key, hot or not, is numbered by up to ``salts`` tasks. Deterministic when
    ``order`` is unique within a key; the order follows (salt, ``order``).
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(order), F.lit(salts)).cast("int")).withColumn("_order", order)
    before = W.partitionBy(by).orderBy("_salt").rowsBetween(W.unboundedPreceding, -1)
    lift = salted.groupBy(by, "_salt").agg(F.count(F.lit(1)).alias("_n"))
    lift = lift.withColumn("_lift", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    numbered = salted.withColumn("_local", F.row_number().over(W.partitionBy(by, "_salt").orderBy("_order")))
    return numbered.join(lift, [by, "_salt"]).withColumn(out, F.col("_lift") + F.col("_local")).drop("_salt", "_order", "_lift", "_local")


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Union by name of one or more frames."""
    return reduce(lambda a, b: a.unionByName(b), frames)
