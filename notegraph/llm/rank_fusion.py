"""One ranking from several differently scaled scores: reciprocal rank fusion, safe for hot groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from notegraph.operators.skew import hot_keys, spread_rank

#: The constant added to a rank before it is inverted.
RRF_K = 60
#: Digits to which totals are compared.
DIGITS = 12


def _candidates(scores: DataFrame, group: str, item: str, signals: list[str]) -> DataFrame:
    """Distinct (group, item) with NaN turned to null; an item logged again with other values keeps its greatest."""
    real = [F.max(F.when(~F.isnan(s), F.col(s))).alias(s) for s in signals]
    return scores.groupBy(group, item).agg(*real)


def _total(signals: list[str], k: int):
    parts = [F.coalesce(F.lit(1.0) / (F.lit(float(k)) + F.col(f"_r_{s}")), F.lit(0.0)) for s in signals]
    return sum(parts[1:], parts[0])


def reciprocal_rank_fusion(scores: DataFrame, group: str, item: str, signals: list[str], k: int = RRF_K, hot: list | None = None) -> DataFrame:
    """``(group, item, fused, n_signals)``: the sum over ``signals`` of ``1 / (k + rank)`` within the group.

    Ranks are competition ranks, descending: equal scores share the better rank, so a signal that is constant in a
    group favours nobody. Null and NaN scores give no rank and no contribution. Items without any signal are left
    out; rows with a null group or item are no candidates; exact duplicate rows count once. Extra columns are ignored.

    Ordinary groups need one shuffle on ``group``, after which deduplication and all rank windows run in place. Groups
    in ``hot`` (found by :func:`notegraph.operators.skew.hot_keys` when not given) are ranked by counting instead, so
    none of their stages holds a whole group in one task.
    """
    rows = scores.select(group, item, *[F.col(s).cast("double").alias(s) for s in signals])
    rows = rows.where(F.col(group).isNotNull() & F.col(item).isNotNull())
    if hot is None:
        hot = hot_keys(rows, group)
    cold = rows.where(~F.col(group).isin(hot)) if hot else rows
    ranked = _candidates(cold.repartition(group), group, item, signals)
    for s in signals:
        w = W.partitionBy(group).orderBy(F.desc_nulls_last(s))
        ranked = ranked.withColumn(f"_r_{s}", F.when(F.col(s).isNotNull(), F.rank().over(w)))
    out = ranked.select(group, item, _total(signals, k).alias("fused"), _known(signals))
    if hot:
        long = _candidates(rows.where(F.col(group).isin(hot)), group, item, signals).unpivot([group, item], signals, "_signal", "_value")
        spread = spread_rank(long.where("_value is not null"), [group, "_signal"], "_value", "_rank")
        part = F.lit(1.0) / (F.lit(float(k)) + F.col("_rank"))
        hots = spread.groupBy(group, item).agg(F.sum(part).alias("fused"), F.count(F.lit(1)).cast("int").alias("n_signals"))
        out = out.unionByName(hots)
    return out.where("n_signals > 0")


def _known(signals: list[str]):
    return sum((F.col(s).isNotNull().cast("int") for s in signals[1:]), F.col(signals[0]).isNotNull().cast("int")).alias("n_signals")


def fused_top(fused: DataFrame, limits: DataFrame, group: str, item: str, limit: str, hot: list | None = None) -> DataFrame:
    """The best ``limit`` items of each group in ``limits``; ties go to the lesser item. Null limits give nothing.
    Totals are compared rounded to ``DIGITS``, so that the order of summation decides nothing.

    Hot groups are first cut at the competition rank, by counting, before a window orders what is left.
    """
    tops = limits.where(F.col(group).isNotNull()).groupBy(group).agg(F.max(limit).alias("_limit"))
    best = W.partitionBy(group).orderBy(F.round("fused", DIGITS).desc(), F.asc(item))

    def cut(df: DataFrame) -> DataFrame:
        return df.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= F.col("_limit"))

    if not hot:
        return cut(fused.join(tops, group)).select(group, item, "fused", "rank")
    few = spread_rank(fused.where(F.col(group).isin(hot)).withColumn("fused", F.round("fused", DIGITS)), [group], "fused", "_rank").join(F.broadcast(tops.where(F.col(group).isin(hot))), group)
    parts = cut(fused.where(~F.col(group).isin(hot)).join(tops, group)).unionByName(cut(few.where("_rank <= _limit").drop("_rank")))
    return parts.select(group, item, "fused", "rank")
