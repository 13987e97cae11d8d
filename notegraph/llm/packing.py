"""Filling containers of fixed capacity: best fit over a histogram of lengths, then documents take the planned slots."""

from __future__ import annotations

import bisect
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notegraph.operators.skew import spread_row_number


@dataclass(frozen=True)
class Slots:
    """``count`` slots of one length: ranks from ``rank`` on, ``per`` to a container, containers from ``container`` on."""

    length: int
    rank: int
    count: int
    per: int
    container: int
    start: int


def plan(histogram: dict[int, int], capacity: int) -> tuple[list[Slots], int]:
    """Slots for every item of a histogram of lengths in 1..capacity, and the number of containers.

    Best fit decreasing, done for all items of a length at once: the open containers are kept as counts by room left.
    Longest first, the items of a length go where the least room remains that still holds them; what finds no place
    opens new containers, each filled with as many of that length as fit. A class of containers that is only partly
    used is split in two, so the state has at most one entry per room and split: its size follows the number of
    distinct lengths (at most ``capacity``), not the number of items.
    """
    rooms: dict[int, list[tuple[int, int]]] = {}
    sizes: list[int] = []
    slots: list[Slots] = []
    taken: Counter[int] = Counter()
    containers = 0

    def put(room: int, first: int, many: int) -> None:
        if room not in rooms:
            rooms[room] = []
            bisect.insort(sizes, room)
        rooms[room].append((first, many))

    def place(length: int, first: int, many: int, per: int, room: int) -> None:
        slots.append(Slots(length, taken[length], many * per, per, first, capacity - room))
        taken[length] += many * per
        if room - per * length:
            put(room - per * length, first, many)

    for length in sorted((n for n, c in histogram.items() if c > 0), reverse=True):
        left = histogram[length]
        while left and (k := bisect.bisect_left(sizes, length)) < len(sizes):
            room = sizes[k]
            first, many = rooms[room].pop()
            if not rooms[room]:
                del rooms[room], sizes[k]
            per = min(room // length, left)
            use = min(many, left // per)
            if use < many:
                put(room, first + use, many - use)
            place(length, first, use, per, room)
            left -= use * per
        if left:
            per = capacity // length
            if full := left // per:
                place(length, containers, full, per, capacity)
                containers += full
            if rest := left % per:
                place(length, containers, 1, rest, capacity)
                containers += 1
    return slots, containers


def pack(sized: DataFrame, key: str, size: str, budgets: DataFrame, budget: str, capacity: str) -> DataFrame:
    """``(budget, key, part, container_id, start, n_tokens)``: every item in a container of every budget.

    An item longer than the capacity is divided into parts of exactly the capacity, which fill containers of their
    own, and a remainder; no other item is divided. Items of size 0 take no room and are spread evenly over the
    containers (in container 0 if there is no other). Null sizes count as 0; null keys are dropped; budgets with a
    null or non-positive capacity are ignored. ``key`` must be unique; repeated rows count once.

    The histogram (at most ``capacity`` rows) is all the driver sees. Documents then take slots by their rank among
    those of the same length: ranks come from salted counts, so a length that a third of all items share is no hot
    group, and the slot of a rank is looked up in the plan, whose size follows the number of distinct lengths.
    """
    spark = sized.sparkSession
    items = sized.where(F.col(key).isNotNull()).groupBy(key).agg(F.coalesce(F.max(size), F.lit(0)).cast("long").alias("_size"))
    wanted = {r[0]: int(r[1]) for r in budgets.select(budget, capacity).distinct().collect() if r[0] is not None and (r[1] or 0) > 0}
    kind, id_kind = sized.schema[key].dataType.simpleString(), budgets.schema[budget].dataType.simpleString()
    schema = f"budget {id_kind}, key {kind}, part int, container_id bigint, start int, n_tokens int"
    if not wanted:
        return spark.createDataFrame([], schema.replace("budget ", f"{budget} ").replace("key ", f"{key} "))
    caps = F.explode(F.map_from_arrays(F.array(*[F.lit(b).cast(id_kind) for b in wanted]), F.array(*[F.lit(c) for c in wanted.values()])))
    cut = items.select(key, "_size", caps.alias("_budget", "_cap"))
    cut = cut.withColumn("_rest", F.when(F.col("_size") > F.col("_cap"), F.col("_size") % F.col("_cap")).otherwise(F.col("_size")).cast("int"))
    cut = cut.withColumn("_whole", F.when(F.col("_size") > F.col("_cap"), (F.col("_size") / F.col("_cap")).cast("long")).otherwise(F.lit(0)))
    counts = cut.groupBy("_budget", "_rest").agg(F.count(F.lit(1)).alias("n"), F.sum("_whole").alias("whole")).collect()
    plans: dict = {}
    for b, c in wanted.items():
        mine = {r["_rest"]: r["n"] for r in counts if r["_budget"] == b}
        made, n = plan({k: v for k, v in mine.items() if k}, c)
        plans[b] = (made, n, sum(r["whole"] or 0 for r in counts if r["_budget"] == b))
    table = {(b, s): [] for b, (made, _, _) in plans.items() for s in {x.length for x in made}}
    for b, (made, _, _) in plans.items():
        for x in made:
            table[b, x.length].append((x.rank, x.per, x.container, x.start))
    shared = spark.sparkContext.broadcast(({k: sorted(v) for k, v in table.items()}, {b: (n, whole) for b, (_, n, whole) in plans.items()}))

    ranked = spread_row_number(cut.withColumn("_class", F.concat_ws(":", "_budget", "_rest")), "_class", F.col(key), "_rank")
    # Whole parts get containers behind the planned ones: numbered by a running total over salts, as the ranks are.
    big = cut.where("_whole > 0").groupBy("_budget", key).agg(F.max("_whole").alias("_whole"))
    offsets = _running(big, "_budget", key, "_whole")
    full = ranked.join(offsets, ["_budget", key], "left") if any(w for _, _, w in plans.values()) else ranked.withColumn("_before", F.lit(None).cast("long"))
    full = full.select("_budget", key, "_cap", "_rest", F.col("_whole").cast("long").alias("_whole"), F.col("_rank").cast("long").alias("_rank"), F.coalesce("_before", F.lit(0)).cast("long").alias("_before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, ends = shared.value
        starts = {k: [x[0] for x in v] for k, v in slots.items()}
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for b, k, cap, rest, whole, rank, before in zip(*(c.to_pylist() for c in batch.columns)):
                containers, _ = ends[b]
                rows = [(p, containers + before + p, 0, cap) for p in range(whole)]
                if rest:
                    at = bisect.bisect_right(starts[b, rest], rank - 1) - 1
                    first, per, container, start = slots[b, rest][at]
                    into, nth = divmod(rank - 1 - first, per)
                    rows.append((whole, container + into, start + nth * rest, rest))
                elif not whole:
                    rows.append((0, (rank - 1) % max(1, containers), 0, 0))
                for p, c, s, n in rows:
                    for column, value in zip(out, (b, k, p, c, s, n)):
                        column.append(value)
            kinds = (batch.schema.field(0).type, batch.schema.field(1).type, pa.int32(), pa.int64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, kinds)], ["budget", "key", "part", "container_id", "start", "n_tokens"])

    return full.mapInArrow(run, schema).withColumnsRenamed({"budget": budget, "key": key})


def _running(df: DataFrame, by: str, key: str, value: str, salts: int = 256) -> DataFrame:
    """``(by, key, _before)``: the total of ``value`` over the rows of ``by`` that come before in (salt, key) order."""
    from pyspark.sql import Window as W

    salted = df.withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(salts)).cast("int"))
    before = W.partitionBy(by).orderBy("_salt").rowsBetween(W.unboundedPreceding, -1)
    lift = salted.groupBy(by, "_salt").agg(F.sum(value).alias("_sum")).withColumn("_lift", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    inside = W.partitionBy(by, "_salt").orderBy(key).rowsBetween(W.unboundedPreceding, -1)
    local = salted.withColumn("_local", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return local.join(lift, [by, "_salt"]).select(by, key, (F.col("_lift") + F.col("_local")).alias("_before"))


def fill_report(packed: DataFrame, budgets: DataFrame, budget: str, capacity: str) -> DataFrame:
    """Per budget: containers used, tokens, and the share of the containers' room that is left over."""
    used = packed.groupBy(budget, "container_id").agg(F.sum("n_tokens").alias("t")).groupBy(budget).agg(F.count(F.lit(1)).alias("containers"), F.sum("t").alias("tokens"))
    caps = budgets.select(budget, capacity).distinct()
    return used.join(caps, budget).select(budget, capacity, "containers", "tokens", (1 - F.col("tokens") / (F.col("containers") * F.col(capacity))).alias("unused_share"))
