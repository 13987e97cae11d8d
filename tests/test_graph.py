import itertools
import random

import pytest

from notegraph.operators import graph as g

HAND = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "e"), ("f", "g")]


def edges(spark, rows):
    return spark.createDataFrame(rows, "src string, dst string")


def parts(near, without=None):
    seen, n = set(), 0
    for start in near:
        if start in seen or start == without:
            continue
        n += 1
        stack = [start]
        while stack:
            v = stack.pop()
            if v in seen or v == without:
                continue
            seen.add(v)
            stack += near[v]
    return n


def brute_cut_nodes(rows):
    near = {}
    for a, b in rows:
        near.setdefault(a, set())
        near.setdefault(b, set())
        if a != b:
            near[a].add(b)
            near[b].add(a)
    whole = parts(near)
    return {v for v in near if parts(near, v) > whole - (not near[v])}


def test_link_scan_keeps_labels_and_drops_repeats(spark):
    notes = spark.createDataFrame([("x", "see [[a]] and [[ a ]] and [[b|label]] [[]]"), ("y", None), ("z", ""), (None, "[[a]]")], "title string, body string")
    assert {tuple(r) for r in g.link_scan(notes, "title", "body").collect()} == {("x", "a"), ("x", "b|label")}


def test_orphans_dangling_self_link(spark):
    notes = spark.createDataFrame([("e",), ("q",), ("d",)], "title string")
    e = edges(spark, HAND)
    assert {r.title for r in g.orphans(notes, "title", e).collect()} == {"q"}
    assert {r.title for r in g.dangling(notes, "title", e).collect()} == {"a", "b", "c", "g"}


@pytest.mark.parametrize("seed", range(4))
def test_articulation_points_against_removal(spark, seed):
    rnd = random.Random(seed)
    rows = list({(f"n{rnd.randrange(14)}", f"n{rnd.randrange(14)}") for _ in range(16)})
    assert {r.id for r in g.articulation_points(edges(spark, rows)).collect()} == brute_cut_nodes(rows)


@pytest.mark.parametrize("seed", [1])
def test_spread_articulation_points_against_removal(spark, seed):
    rnd = random.Random(seed)
    rows = list({(f"n{rnd.randrange(24)}", f"n{rnd.randrange(24)}") for _ in range(26)})
    assert {r.id for r in g.articulation_points(edges(spark, rows), task_edges=0).collect()} == brute_cut_nodes(rows)


def test_components_do_not_depend_on_partitions(spark):
    rows = [(f"n{i}", f"n{i + 1}") for i in range(40)] + [("x", "y"), ("z", "z")]
    wanted = {f"n{i}": min(f"n{j}" for j in range(41)) for i in range(41)} | {"x": "x", "y": "x", "z": "z"}
    for n in (1, 7):
        found = g.components(edges(spark, rows).repartition(n))
        assert {r.id: r.component for r in found.collect()} == wanted


def test_pagerank_keeps_its_mass_and_the_personalised_one_loses_it_at_sinks(spark):
    e = edges(spark, HAND)
    assert sum(r["rank"] for r in g.pagerank(e).collect()) == pytest.approx(1.0)
    seeds = spark.createDataFrame([(1, "f"), (2, "nowhere")], "query_id bigint, id string")
    ranks = g.personalized_pagerank(e, seeds).collect()
    assert sum(r["rank"] for r in ranks if r.query_id == 1) < 0.5
    assert not [r for r in ranks if r.query_id == 2]
    assert len([r for r in ranks if r.query_id is None]) == 7


def test_betweenness_by_paths(spark):
    rows = [("a", "b"), ("b", "c"), ("a", "d"), ("d", "c"), ("c", "e"), ("e", "a")]
    ids = sorted({x for r in rows for x in r})
    out = {v: [b for a, b in rows if a == v] for v in ids}
    wanted = dict.fromkeys(ids, 0.0)
    for s, t in itertools.permutations(ids, 2):
        found, size = [], None
        queue = [[s]]
        while queue:
            path = queue.pop(0)
            if size is not None and len(path) > size:
                break
            if path[-1] == t:
                size = len(path)
                found.append(path)
                continue
            queue += [[*path, b] for b in out[path[-1]] if b not in path]
        for p in found:
            for v in p[1:-1]:
                wanted[v] += 1 / len(found)
    found = {r.id: r.betweenness for r in g.betweenness(edges(spark, rows), normalised=False).collect()}
    assert found == pytest.approx(wanted)


def test_communities_separate_two_cliques(spark):
    rows = [(f"a{i}", f"a{j}") for i in range(5) for j in range(i)] + [(f"b{i}", f"b{j}") for i in range(5) for j in range(i)] + [("a0", "b0")]
    e = edges(spark, rows)
    labels = g.communities(e)
    by = {r.id: r.community for r in labels.collect()}
    assert len({by[f"a{i}"] for i in range(5)}) == 1 and len({by[f"b{i}"] for i in range(5)}) == 1 and by["a1"] != by["b1"]
    assert g.modularity(e, labels) > 0.3


def test_activation_stops_at_two_hops_and_under_the_least_boost(spark):
    rows = edges(spark, [("a", "b"), ("b", "c"), ("c", "d")])
    sources = spark.createDataFrame([("a", 1.0), ("d", 0.02), ("c", -1.0)], "source string, utility double")
    found = {(r.source, r.id): round(r.boost, 6) for r in g.spread_activation(rows, sources).collect()}
    assert found == {("a", "b"): 0.6, ("a", "c"): 0.36, ("d", "c"): 0.012}


def test_empty_graph(spark):
    e = edges(spark, [])
    for f in (lambda e: g.spread_articulation_points(g.undirected(e)), g.nodes, g.pagerank, g.components, g.articulation_points, g.betweenness, g.communities, g.hubs):
        assert f(e).count() == 0
    assert g.upper_median(g.in_degrees(e), "in_degree").first()[0] == 0


def test_pagerank_of_one_task_and_of_tables(spark, monkeypatch):
    pairs = [("a", "b"), ("b", "c"), ("c", "a"), ("a", "sink"), ("d", "d"), ("e", "a")]
    edges = spark.createDataFrame(pairs, "src string, dst string").repartition(3)
    once = g.pagerank(edges)
    assert "rank" in once.columns and once.rdd.getNumPartitions() == 1
    found = {r.id: round(r["rank"], 12) for r in once.collect()}
    assert len(found) == 6 and abs(sum(found.values()) - 1.0) < 1e-9
    assert not g.pagerank(edges.limit(0)).collect()
    monkeypatch.setattr(g, "TASK_EDGES", 0)
    assert {r.id: round(r["rank"], 12) for r in g.pagerank(edges).collect()} == found
