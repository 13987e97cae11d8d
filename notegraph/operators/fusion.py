"""Fusion of ranked signals, exploration, and what the access log tells about exposure."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from notegraph.operators.skew import hot_keys

#: Weights of the signals and the constant of reciprocal ranks.
SIGNAL_WEIGHTS = {"composite": 2.0, "keyword": 1.0, "graph": 1.5}
RRF_K = 60


def fuse(signals: dict[str, DataFrame], weights: dict[str, float] | None = SIGNAL_WEIGHTS, k: int = RRF_K) -> DataFrame:
    """``(query_id, title, score, <signal>...)`` from one ``(query_id, title, score)`` frame per signal.

    With ``weights`` a signal gives ``weight x score / (k + rank)``, ranks from 1; with None plain ``1 / (k + rank)``.
    One union and one aggregation instead of full outer joins. Ties in a signal go to the lesser title.
    """
    ranked = None
    for name, df in signals.items():
        w = W.partitionBy("query_id").orderBy(F.round("score", 9).desc(), F.col("title").asc())
        rank = F.row_number().over(w)
        part = F.lit(1.0) / (F.lit(k) + rank) if weights is None else F.lit(float(weights[name])) * F.col("score") / (F.lit(k) + rank)
        one = df.select("query_id", "title", F.lit(name).alias("signal"), F.col("score").alias("own"), part.alias("part"))
        ranked = one if ranked is None else ranked.unionByName(one)
    own = [F.max(F.when(F.col("signal") == name, F.col("own"))).alias(name) for name in signals]
    return ranked.groupBy("query_id", "title").agg(F.sum("part").alias("score"), *own)


def explore(ranked: DataFrame, titles: DataFrame, budget: float = 0.1, seed: str = "0") -> DataFrame:
    """Replaces the tail of every result list by unseen titles; ``ranked`` is ``(query_id, title, score, rank)``.

    ``max(1, floor(n x budget))`` results give way; their substitutes are the unseen titles first by the MD5 of seed,
    query and title, so runs agree; they score 0. Too few of them: originals stay. A budget of 0 changes nothing.
    Candidates are cut per query to what could be needed before results are taken out, never all titles x all queries:
    ``titles`` is hashed into a ring once, and a query starts at its own place in it.
    """
    if budget <= 0:
        return ranked.select("query_id", "title", "score", "rank", F.lit(False).alias("was_exploration"))
    sizes = ranked.groupBy("query_id").agg(F.count(F.lit(1)).cast("int").alias("n"))
    sizes = sizes.withColumn("gives", F.greatest(F.lit(1), F.floor(F.col("n") * F.lit(budget)).cast("int")))
    total = titles.count()
    ring = _ring(titles, seed)
    start = F.pmod(F.conv(F.substring(F.md5(F.concat(F.col("query_id").cast("string"), F.lit(seed))), 1, 8), 16, 10).cast("bigint"), F.lit(max(total, 1)))
    tries = sizes.withColumn("start", start).select("query_id", "gives", F.explode(F.sequence(F.lit(0), F.least(F.col("n") + F.col("gives"), F.lit(max(total, 1))) - 1)).alias("step"), "start")
    tries = tries.withColumn("place", (F.col("start") + F.col("step")) % F.lit(max(total, 1)))
    offers = tries.join(ring, "place").join(ranked.select("query_id", F.col("title").alias("pick")), ["query_id", "pick"], "left_anti")
    picks = offers.withColumn("i", F.row_number().over(W.partitionBy("query_id").orderBy("step"))).where(F.col("i") <= F.col("gives")).select("query_id", "pick", "i")
    found = picks.groupBy("query_id").agg(F.count(F.lit(1)).alias("found"))
    kept = ranked.join(sizes, "query_id").join(found, "query_id", "left").withColumn("keep", F.col("n") - F.coalesce("found", F.lit(0)))
    stay = kept.where(F.col("rank") <= F.col("keep")).select("query_id", "title", "score", "rank", F.lit(False).alias("was_exploration"))
    new = picks.join(kept.select("query_id", "keep").distinct(), "query_id").select("query_id", F.col("pick").alias("title"), F.lit(0.0).alias("score"), (F.col("keep") + F.col("i")).cast("int").alias("rank"), F.lit(True).alias("was_exploration"))
    return stay.unionByName(new)


def _ring(titles: DataFrame, seed: str) -> DataFrame:
    """``(pick, place)``: titles in the order of their MD5, numbered from 0. They are numbered within the first three hex
    digits, then lifted by the counts of those before: at most 4,096 counts are ordered in one task."""
    hashed = titles.select(F.col("title").alias("pick"), F.md5(F.concat("title", F.lit(seed))).alias("_hash")).withColumn("_part", F.substring("_hash", 1, 3))
    lift = hashed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    lift = lift.select("_part", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_lift"))
    local = hashed.withColumn("_local", F.row_number().over(W.partitionBy("_part").orderBy("_hash", "pick")))
    return local.join(F.broadcast(lift), "_part").select("pick", (F.col("_lift") + F.col("_local") - 1).alias("place"))


def propensity(log: DataFrame, titles: DataFrame, epsilon: float = 0.01, distinct: bool = False) -> DataFrame:
    """``(title, propensity)`` of every title from a log of ``(event, title)`` rows.

    Occurrences over events, or with ``distinct`` the share of events that show the title; at least ``epsilon``,
    which also stands where there are no events. Counts are combined on the map side.
    """
    events = log.agg(F.countDistinct("event").alias("events"))
    count = F.countDistinct("event") if distinct else F.count(F.lit(1))
    shown = log.groupBy("title").agg(count.alias("n"))
    rate = F.coalesce(F.col("n"), F.lit(0)) / F.greatest(F.col("events"), F.lit(1))
    return titles.select("title").distinct().join(shown, "title", "left").crossJoin(F.broadcast(events)).select("title", F.greatest(rate, F.lit(epsilon)).alias("propensity"))


def combine_boosts(boosts: DataFrame) -> DataFrame:
    """Boosts of several sources for one title, summed: ``(title, boost)``."""
    return boosts.groupBy("title").agg(F.sum("boost").alias("boost"))


def fold_boosts(events: DataFrame, key: str, at: str, boost: str, rate: float = 0.1, hot: list | None = None) -> DataFrame:
    """``(key, boost, updated)``: ``min(1, old x exp(-rate x days) + new)`` over a key's events in order of time.

    Events of one key and time are one, with the sum of their boosts. The fold depends on order, but its steps
    ``x -> min(c, a x + b)`` are closed under composition: the events of a key in ``hot`` (found by
    :func:`notegraph.operators.skew.hot_keys` when not given) are composed within each minute, then within each day,
    then over all days, so no task holds more of it than that; ordinary keys are composed at once. Null keys, times and
    boosts and negative boosts are dropped.
    """
    rows = events.where(F.col(at).isNotNull() & (F.col(boost) >= 0) & F.col(key).isNotNull())
    rows = rows.select(F.col(key).alias("k"), F.unix_micros(F.col(at).cast("timestamp")).alias("t"), F.col(boost).cast("double").alias("b"))
    hot = hot_keys(rows, "k") if hot is None else hot
    rows = rows.groupBy("k", "t").agg(F.sum("b").alias("b"))
    step = F.struct(F.col("t").alias("from"), F.col("t").alias("to"), F.lit(1.0).alias("a"), F.col("b"), F.lit(1.0).alias("c"))
    steps = rows.select("k", step.alias("s"))

    def after(f, g):
        kept = F.exp(F.lit(-rate) * (g["from"] - f["to"]) / F.lit(86_400e6)) * g["a"]
        return F.struct(f["from"].alias("from"), g["to"].alias("to"), (kept * f["a"]).alias("a"), (kept * f["b"] + g["b"]).alias("b"), F.least(g["c"], kept * f["c"] + g["b"]).alias("c"))

    def composed(df: DataFrame, width: int | None) -> DataFrame:
        by = ["k"] if width is None else ["k", F.floor(F.col("s.from") / width).alias("_slice")]
        lists = df.groupBy(*by).agg(F.sort_array(F.collect_list("s")).alias("h"))
        return lists.select("k", F.aggregate(F.slice("h", F.lit(2), F.greatest(F.size("h") - 1, F.lit(0))), F.element_at("h", 1), after).alias("s"))

    if hot:
        long = composed(composed(steps.where(F.col("k").isin(hot)), 60_000_000), 86_400_000_000)
        steps = steps.where(~F.col("k").isin(hot)).unionByName(long)
    return composed(steps, None).select(F.col("k").alias(key), F.least("s.c", "s.b").alias("boost"), F.timestamp_micros("s.to").alias("updated"))
