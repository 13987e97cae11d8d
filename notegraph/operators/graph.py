"""The link graph: scan, set operations, degrees, centrality, communities, articulation points, activation."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from notegraph.operators.skew import spread_row_number
from notegraph.session import cut_lineage

#: Edges and nodes up to which an adjacency is broadcast (120 MB as integers).
BROADCAST_EDGES = 10_000_000
#: Edges of a component up to which one task searches it.
TASK_EDGES = 1_000_000


def link_scan(notes: DataFrame, title: str, content: str) -> DataFrame:
    """Distinct ``(src, dst)`` of ``[[...]]`` in the content: trimmed, non-empty, label and anchor kept verbatim."""
    found = F.transform(F.regexp_extract_all(content, F.lit(r"\[\[([^\]]+)\]\]"), 1), lambda x: F.trim(x))
    return notes.where(F.col(title).isNotNull()).select(F.col(title).alias("src"), F.explode(found).alias("dst")).where("dst <> ''").distinct()


def nodes(edges: DataFrame) -> DataFrame:
    """Distinct ids of sources and targets, dangling ones included."""
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


def undirected(edges: DataFrame) -> DataFrame:
    """Distinct ``(a, b)`` with a < b: self loops and direction dropped."""
    return edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def both_ways(edges: DataFrame) -> DataFrame:
    """``(src, dst)`` in both directions, distinct, without self loops."""
    pairs = undirected(edges)
    return pairs.select(F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))).alias("e")).select("e.*")


def orphans(notes: DataFrame, title: str, edges: DataFrame) -> DataFrame:
    """Titles nothing links to; a note that links to itself is none."""
    return notes.select(F.col(title).alias("title")).where("title is not null").join(edges.select(F.col("dst").alias("title")), "title", "left_anti")


def dangling(notes: DataFrame, title: str, edges: DataFrame) -> DataFrame:
    """Distinct targets that are no title."""
    return edges.select(F.col("dst").alias("title")).join(notes.select(F.col(title).alias("title")), "title", "left_anti").distinct()


def backlinks(edges: DataFrame) -> DataFrame:
    """Per target, the sorted sources; for one note filter on ``dst`` first."""
    return edges.groupBy("dst").agg(F.sort_array(F.collect_set("src")).alias("sources"))


def degree(edges: DataFrame, of: str = "dst") -> DataFrame:
    """``(id, degree)`` over distinct edges: in-degree of ``dst``, out-degree of ``src``."""
    return edges.groupBy(F.col(of).alias("id")).agg(F.count(F.lit(1)).alias("degree"))


def in_degrees(edges: DataFrame) -> DataFrame:
    """In-degree of every node, 0 included."""
    return nodes(edges).join(degree(edges), "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("in_degree"))


def upper_median(degrees: DataFrame, value: str) -> DataFrame:
    """One row: the value at place ``n div 2`` (from 0) of the sorted values; 0 for none.

    Values are counted first, so the sort runs over distinct values and not over rows.
    """
    counts = degrees.groupBy(F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    running = counts.withColumn("upto", F.sum("n").over(W.orderBy("v")))  # one row per distinct degree
    hit = running.crossJoin(F.broadcast(total)).where(F.expr("upto > total div 2")).agg(F.min("v").alias("upper_median"))
    return hit.select(F.coalesce("upper_median", F.lit(0)).cast("bigint").alias("upper_median"))


def hubs(edges: DataFrame, factor: float = 2.0) -> DataFrame:
    """Nodes with in-degree over ``factor`` times the upper median, where that is positive."""
    d = in_degrees(edges)
    limit = upper_median(d, "in_degree")
    return d.crossJoin(F.broadcast(limit)).where((F.col("upper_median") * factor > 0) & (F.col("in_degree") > F.col("upper_median") * factor)).select("id", "in_degree")


def map_nodes(edges: DataFrame) -> DataFrame:
    return nodes(edges).where(F.col("id").endswith(" map") | (F.col("id") == "index"))


def connectors(notes: DataFrame, edges: DataFrame, least: int = 3) -> DataFrame:
    """Notes of two or more projects with in-degree ``least`` or more."""
    wide = notes.where(F.size("project") >= 2).select(F.col("title").alias("id"))
    return wide.join(degree(edges).where(F.col("degree") >= least), "id").select("id")


def bridges(notes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(id, reason)``: articulation points, hubs, map notes, cross-project connectors."""
    parts = [
        (articulation_points(edges), "articulation"), (hubs(edges).select("id"), "hub"), (map_nodes(edges), "map"), (connectors(notes, edges), "connector"),
    ]
    out = None
    for df, reason in parts:
        one = df.select("id", F.lit(reason).alias("reason"))
        out = one if out is None else out.unionByName(one)
    return out.distinct()


def pagerank(edges: DataFrame, alpha: float = 0.85, rounds: int = 20) -> DataFrame:
    """``(id, rank)`` after ``rounds`` rounds from a uniform start; the mass of nodes without links goes to all alike.

    Unweighted, directed, self loops count. A graph of up to ``TASK_EDGES`` edges is ranked in one task. In a larger one a round is one join on the source and one map-side combined sum. A round
    reads the ranks twice (what is passed on, what is lost at sinks), so they are written to the shared folder each
    round: a chain of rounds would be planned twice as large with every one.
    """
    edges = cut_lineage(edges)
    if edges.count() <= TASK_EDGES:
        ids = edges.schema["src"].dataType.simpleString()
        named = edges.select("src", "dst").coalesce(1)
        return cut_lineage(named.mapInArrow(partial(_ranked_at_once, alpha=alpha, rounds=rounds), f"id {ids}, rank double"))
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = degree(edges, "src").select(F.col("id").alias("src"), F.col("degree").alias("out"))
    every = cut_lineage(nodes(edges).join(out.withColumnRenamed("src", "id"), "id", "left").select("id", F.col("out").isNull().alias("sink")))
    n = every.count()
    if not n:
        return every.select("id", F.lit(0.0).alias("rank"))
    # Links stay where their source is, nodes where their id is, through all rounds: only ranks travel.
    links = cut_lineage(edges.join(out, "src").select("src", "dst", "out")).repartition(parts, "src").persist()
    placed = every.repartition(parts, "id").persist()
    ranks = every.select("id", "sink", F.lit(1.0 / n).alias("rank"))
    for _ in range(rounds):
        lost = ranks.agg(F.coalesce(F.sum(F.when(F.col("sink"), F.col("rank"))), F.lit(0.0)).alias("lost"))
        sent = links.join(ranks.select(F.col("id").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") / F.col("out")).alias("got"))
        new = placed.join(sent, "id", "left").crossJoin(F.broadcast(lost))
        ranks = cut_lineage(new.select("id", "sink", (F.lit((1 - alpha) / n) + F.lit(alpha) * (F.coalesce("got", F.lit(0.0)) + F.col("lost") / F.lit(n))).alias("rank")))
    links.unpersist()
    placed.unpersist()
    return ranks.select("id", "rank")


def _ranked_at_once(batches: Iterator[pa.RecordBatch], alpha: float, rounds: int) -> Iterator[pa.RecordBatch]:
    """The rounds of :func:`pagerank` over a whole graph as integers."""
    import numpy as np

    held = [b for b in batches if b.num_rows]
    if not held:
        return
    rows = pa.Table.from_batches(held)
    ends = pa.chunked_array([*rows["src"].chunks, *rows["dst"].chunks]).combine_chunks().dictionary_encode()
    places = ends.indices.to_numpy()
    src, dst, n = places[: rows.num_rows], places[rows.num_rows :], len(ends.dictionary)
    out = np.bincount(src, minlength=n)
    rank = np.full(n, 1.0 / n)
    for _ in range(rounds):
        got = np.bincount(dst, weights=(rank / np.maximum(out, 1))[src], minlength=n)
        rank = (1 - alpha) / n + alpha * (got + rank[out == 0].sum() / n)
    yield pa.RecordBatch.from_arrays([ends.dictionary, pa.array(rank)], ["id", "rank"])


def personalized_pagerank(edges: DataFrame, seeds: DataFrame, alpha: float = 0.85, rounds: int = 20, cut_every: int = 5) -> DataFrame:
    """``(query_id, id, rank)`` for all queries at once; ``seeds`` has ``(query_id, id)``.

    Starts at the seeds that are nodes, uniformly; the mass of nodes without links is dropped. A query without a valid
    seed starts uniformly over all nodes: these queries share one run, returned under a null ``query_id``, and take
    their rows from there. Only nodes reached have a row.
    """
    every = cut_lineage(nodes(edges))
    n = every.count()
    out = degree(edges, "src").select(F.col("id").alias("src"), F.col("degree").alias("out"))
    links = cut_lineage(edges.join(out, "src").select("src", "dst", "out"))
    valid = seeds.join(every, "id").distinct()
    count = valid.groupBy("query_id").agg(F.count(F.lit(1)).alias("k"))
    own = valid.join(count, "query_id").select("query_id", "id", (F.lit(1.0) / F.col("k")).alias("start"))
    base = cut_lineage(own.unionByName(every.select(F.lit(None).cast(seeds.schema["query_id"].dataType).alias("query_id"), "id", F.lit(1.0 / max(n, 1)).alias("start"))))
    ranks = base.select("query_id", "id", F.col("start").alias("rank"))
    for i in range(rounds):
        sent = links.join(ranks.select("query_id", F.col("id").alias("src"), "rank"), "src").select("query_id", F.col("dst").alias("id"), (F.lit(alpha) * F.col("rank") / F.col("out")).alias("part"))
        back = base.select("query_id", "id", (F.lit(1 - alpha) * F.col("start")).alias("part"))
        ranks = sent.unionByName(back).groupBy("query_id", "id").agg(F.sum("part").alias("rank"))
        if (i + 1) % cut_every == 0:
            ranks = cut_lineage(ranks)
    return ranks


def spread_activation(edges: DataFrame, sources: DataFrame, damping: float = 0.6, least: float = 0.01) -> DataFrame:
    """``(source, id, hop, boost)`` from ``sources(source, utility)``: undirected, two hops, utility x damping^hop.

    A node below ``least`` gets nothing and passes nothing on; the source itself gets none; a node within both hops
    counts at the nearer. Utilities that are not positive give nothing. Where ``sources`` has a column ``start``, that is
    the node from which a source spreads, so that one node may spread on several occasions.
    """
    links = both_ways(edges)
    if "start" not in sources.columns:
        sources = sources.withColumn("start", F.col("source"))
    start = sources.where("utility > 0").groupBy("source", "start").agg(F.max("utility").alias("utility"))
    first = start.join(links, F.col("start") == F.col("src")).select("source", "start", "utility", F.col("dst").alias("id"), F.lit(1).alias("hop")).where(F.col("utility") * damping >= least)
    second = first.join(links, F.col("id") == F.col("src")).select("source", "start", "utility", F.col("dst").alias("id"), F.lit(2).alias("hop")).where((F.col("id") != F.col("start")) & (F.col("utility") * damping * damping >= least))
    near = first.unionByName(second).groupBy("source", "utility", "id").agg(F.min("hop").alias("hop"))
    boost = F.when(F.col("hop") == 1, F.col("utility") * damping).otherwise(F.col("utility") * damping * damping)
    return near.select("source", "id", "hop", boost.alias("boost"))


def components(edges: DataFrame) -> DataFrame:
    """``(id, component)``: the least id of the connected component, direction ignored.

    Labels are exchanged with neighbours and then shortened through the label's own label, so rounds grow with the
    logarithm of the diameter; each round is written to the shared folder. Labels only ever fall, so it ends, and it
    ends only when nothing changes.
    """
    links = cut_lineage(both_ways(edges))
    labels = cut_lineage(nodes(edges).withColumn("component", F.col("id")))
    while True:
        offered = links.join(labels.select(F.col("id").alias("src"), "component"), "src").select(F.col("dst").alias("id"), "component")
        least = labels.unionByName(offered).groupBy("id").agg(F.min("component").alias("component"))
        hop = least.select(F.col("id").alias("component"), F.col("component").alias("further"))
        new = cut_lineage(least.join(hop, "component", "left").select("id", F.least("component", "further").alias("component")))
        if new.join(labels.withColumnRenamed("component", "old"), "id").where("component <> old").limit(1).count() == 0:
            return new
        labels = new


def articulation_points(edges: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """``(id)`` of the nodes whose removal splits their component; direction ignored.

    Components of up to ``task_edges`` edges are searched depth first, each in one task, without recursion; larger ones
    by :func:`spread_articulation_points`, which holds no component in a task. Both are exact.
    """
    comp = components(edges)
    pairs = cut_lineage(undirected(edges).join(comp.withColumnRenamed("id", "a"), "a").select("component", "a", "b"))
    large = [r[0] for r in pairs.groupBy("component").count().where(F.col("count") > task_edges).select("component").collect()]
    kind = edges.schema["src"].dataType.simpleString()

    def search(pdf):
        import pandas as pd

        near: dict = {}
        for a, b in zip(pdf["a"], pdf["b"]):
            near.setdefault(a, []).append(b)
            near.setdefault(b, []).append(a)
        return pd.DataFrame({"id": pd.Series(sorted(_cut_nodes(near)), dtype=object)})

    found = pairs.where(~F.col("component").isin(large)).groupBy("component").applyInPandas(search, f"id {kind}")
    if large:
        found = found.unionByName(spread_articulation_points(pairs.where(F.col("component").isin(large)).select("a", "b")))
    return found.distinct()


def spread_articulation_points(pairs: DataFrame) -> DataFrame:
    """Articulation points of undirected ``(a, b)`` pairs, by tables alone.

    A breadth-first tree is grown from the least node of each component, a level a round. The tree edges on the cycle
    that a further edge closes belong to one biconnected part: both its ends climb the tree till they meet, pairs that
    coincide go on as one, and each step ties neighbouring tree edges (named by their lower node) together. The
    components of these ties are the parts; a node whose tree edges lie in two of them is a cut node. Rounds are twice
    the depth of the tree.
    """
    links = cut_lineage(pairs.select(F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))).alias("e")).select("e.*"))
    roots = components(links.select("src", "dst")).groupBy("component").agg(F.lit(1)).select(F.col("component").alias("id"))
    level = cut_lineage(roots.select("id", F.lit(None).cast(links.schema["src"].dataType).alias("parent"), F.lit(0).alias("depth")))
    tree = level
    depth = 0
    while True:
        depth += 1
        reached = links.join(level.select(F.col("id").alias("src")), "src").groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("parent"))
        level = cut_lineage(reached.join(tree.select("id"), "id", "left_anti").withColumn("depth", F.lit(depth)))
        if level.limit(1).count() == 0:
            break
        tree = cut_lineage(tree.unionByName(level))
    up = tree.select("id", "parent", "depth")
    a, b = (up.select(F.col("id").alias(c), F.col("parent").alias(f"p{c}"), F.col("depth").alias(f"d{c}")) for c in "ab")
    walk = cut_lineage(pairs.join(a, "a").join(b, "b").where("not (pa <=> b) and not (pb <=> a)").select("a", "b"))
    ties = None
    while walk.limit(1).count():
        # The deeper end climbs; of equal ends both do. An end that arrives at the other has met it.
        at = walk.join(a, "a").join(b, "b")
        na, nb = F.when(F.col("da") >= F.col("db"), F.col("pa")).otherwise(F.col("a")), F.when(F.col("db") >= F.col("da"), F.col("pb")).otherwise(F.col("b"))
        step = cut_lineage(at.select("a", "b", na.alias("na"), nb.alias("nb")))
        met = F.col("na") == F.col("nb")
        tied = F.filter(
            F.array(
                F.when(met & (F.col("a") != F.col("na")) & (F.col("b") != F.col("nb")), F.struct(F.col("a").alias("src"), F.col("b").alias("dst"))),
                F.when(~met & (F.col("na") != F.col("a")), F.struct(F.col("a").alias("src"), F.col("na").alias("dst"))),
                F.when(~met & (F.col("nb") != F.col("b")), F.struct(F.col("b").alias("src"), F.col("nb").alias("dst"))),
            ),
            lambda x: x.isNotNull(),
        )
        one = step.select(F.explode(tied).alias("t")).select("t.*").distinct()
        ties = cut_lineage(one if ties is None else ties.unionByName(one).distinct())
        walk = cut_lineage(step.where(~met).select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b")).distinct())
    below = tree.where("parent is not null").select(F.col("id").alias("edge"), "parent")
    if ties is not None:
        part = components(ties).withColumnRenamed("id", "edge")
        below = below.join(part, "edge", "left").select("edge", "parent", F.coalesce("component", "edge").alias("part"))
    else:
        below = below.withColumn("part", F.col("edge"))
    ends = below.select(F.explode(F.array("edge", "parent")).alias("id"), "part")
    return ends.groupBy("id").agg(F.min("part").alias("least"), F.max("part").alias("most")).where("least <> most").select("id")


def _cut_nodes(near: dict) -> set:
    """Cut nodes of a graph given as neighbour lists: low points over an explicit stack."""
    order: dict = {}
    low: dict = {}
    found: set = set()
    for root in near:
        if root in order:
            continue
        order[root] = low[root] = len(order)
        stack, branches = [(root, None, iter(near[root]))], 0
        while stack:
            node, parent, rest = stack[-1]
            for other in rest:
                if other == parent:
                    continue
                if other in order:
                    low[node] = min(low[node], order[other])
                    continue
                order[other] = low[other] = len(order)
                stack.append((other, node, iter(near[other])))
                break
            else:
                stack.pop()
                if parent is None:
                    continue
                low[parent] = min(low[parent], low[node])
                if parent == root:
                    branches += 1
                elif low[node] >= order[parent]:
                    found.add(parent)
        if branches > 1:
            found.add(root)
    return found


def betweenness(edges: DataFrame, normalised: bool = True) -> DataFrame:
    """``(id, betweenness)``: shares of shortest paths through a node, directed, unweighted, self loops ignored.

    Brandes' accumulation, sources spread over the tasks, whole levels at a time in NumPy; each task keeps one number per
    node and sums are combined before the shuffle. Nodes are numbered, and the adjacency is broadcast as two integer
    arrays after its size is checked: 4 bytes an edge and 8 a node, at most 120 MB. Above ``BROADCAST_EDGES`` edges or
    nodes the call is refused, since exact betweenness costs nodes x edges.
    """
    import numpy as np

    ids = cut_lineage(spread_row_number(nodes(edges).withColumn("_all", F.lit(0)), "_all", F.col("id"), "_place").select("id", (F.col("_place") - 1).cast("int").alias("place")))
    links = edges.where("src <> dst").distinct()
    n = ids.count()
    if links.count() > BROADCAST_EDGES or n > BROADCAST_EDGES:
        raise ValueError("too many edges for exact betweenness")
    named = links.join(ids.select(F.col("id").alias("src"), F.col("place").alias("s")), "src").join(ids.select(F.col("id").alias("dst"), F.col("place").alias("d")), "dst")
    table = named.select("s", "d").toArrow()
    s, d = (table.column(c).to_numpy().astype("i4") for c in (0, 1))
    order = np.argsort(s, kind="stable")
    first = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=n))]).astype("i8")
    shared = edges.sparkSession.sparkContext.broadcast((first, d[order]))
    scale = 1.0 / ((n - 1) * (n - 2)) if normalised and n > 2 else 1.0

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        first, out = shared.value
        total = np.zeros(len(first) - 1)
        for pdf in batches:
            for source in pdf["place"]:
                _accumulate(int(source), first, out, total)
        through = np.nonzero(total)[0]
        yield pd.DataFrame({"place": through.astype("i4"), "part": total[through]})

    parts = ids.select("place").repartition(edges.sparkSession.sparkContext.defaultParallelism).mapInPandas(run, "place int, part double")
    sums = parts.groupBy("place").agg(F.sum("part").alias("s"))
    return ids.join(sums, "place", "left").select("id", (F.coalesce("s", F.lit(0.0)) * scale).alias("betweenness"))


def _accumulate(source: int, first, out, total) -> None:
    """Adds the dependencies of one source on all nodes to ``total``: levels forward, then backward."""
    import numpy as np

    depth = np.full(len(first) - 1, -1, "i4")
    paths = np.zeros(len(first) - 1)
    depth[source], paths[source] = 0, 1.0
    level, steps = np.array([source]), []
    while len(level):
        size = first[level + 1] - first[level]
        tail = np.repeat(level, size)
        head = out[np.repeat(first[level] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())]
        new = np.unique(head[depth[head] < 0])
        depth[new] = depth[source] + len(steps) + 1
        along = depth[head] == len(steps) + 1
        tail, head = tail[along], head[along]
        np.add.at(paths, head, paths[tail])
        steps.append((tail, head))
        level = new
    share = np.zeros(len(paths))
    for tail, head in reversed(steps):
        np.add.at(share, tail, paths[tail] / paths[head] * (1.0 + share[head]))
    share[source] = 0.0
    total += share


def communities(edges: DataFrame, rounds: int = 8) -> DataFrame:
    """``(id, community)`` by label propagation on the undirected graph, the same on every run.

    Each round a node takes the label most frequent among its neighbours and itself, the least of equals; after
    ``rounds`` rounds labels stand. Counts are combined on the map side, so hubs are no hot groups.
    """
    links = cut_lineage(both_ways(edges))
    labels = nodes(edges).withColumn("community", F.col("id"))
    for i in range(rounds):
        votes = links.join(labels.select(F.col("id").alias("src"), "community"), "src").select(F.col("dst").alias("id"), "community")
        counted = votes.unionByName(labels).groupBy("id", "community").agg(F.count(F.lit(1)).alias("n"))
        labels = counted.groupBy("id").agg(F.min(F.struct((-F.col("n")).alias("n"), "community"))["community"].alias("community"))
        if i % 2:
            labels = cut_lineage(labels)
    return labels


def modularity(edges: DataFrame, labels: DataFrame) -> float:
    """Share of undirected edges inside communities, less what their degrees would give by chance."""
    pairs = undirected(edges).join(labels.select(F.col("id").alias("a"), F.col("community").alias("ca")), "a").join(labels.select(F.col("id").alias("b"), F.col("community").alias("cb")), "b")
    m = pairs.count()
    if not m:
        return 0.0
    inside = pairs.where("ca = cb").count() / m
    ends = pairs.select(F.explode(F.array("ca", "cb")).alias("c")).groupBy("c").agg(F.count(F.lit(1)).alias("d"))
    return inside - ends.agg(F.sum((F.col("d") / (2.0 * m)) ** 2)).first()[0]


def graph_summary(edges: DataFrame, labels: DataFrame, bridge_ids: DataFrame) -> DataFrame:
    """One row: numbers of nodes, edges, communities and bridges."""
    return (
        nodes(edges).agg(F.count(F.lit(1)).alias("n_nodes")).crossJoin(edges.agg(F.count(F.lit(1)).alias("n_edges")))
        .crossJoin(labels.agg(F.countDistinct("community").alias("n_communities"))).crossJoin(bridge_ids.agg(F.countDistinct("id").alias("n_bridges")))
    )
