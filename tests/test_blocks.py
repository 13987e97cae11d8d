"""Operators that meet two tables block by block give what all pairs give."""

from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from conftest import SF
from notegraph.operators import links, retrieval, rules, text_index
from notegraph.plans import search


def test_bm25_of_blocks_is_that_of_all_pairs(spark, monkeypatch):
    docs = spark.createDataFrame([(f"n{i:03}", f"shard {'retry ' * (i % 4)}" + ("limit" if i % 3 else "")) for i in range(90)] + [("empty", None)], "title string, body string")
    asked = [(1, "retry limit"), (2, "limit retry"), (3, "shard"), (4, "retry retry shard"), (5, "nowhere"), (6, ""), (7, None), (8, "the of")]
    queries = spark.createDataFrame(asked, "query_id bigint, query string")
    wanted = text_index.top_k(text_index.bm25(queries, "query_id", "query", docs, "title", {"body": 1.0}), "query_id", "title", 10)
    wanted = {(r.query_id, r.title, r["rank"], round(r.score, 9)) for r in wanted.collect()}
    assert {w[0] for w in wanted} == {1, 2, 3, 4}
    for bags, size in ((32_768, 8_192), (2, 20)):
        monkeypatch.setattr(text_index, "BAGS", bags)
        monkeypatch.setattr(text_index, "DOCS", size)
        found = text_index.bm25_top(queries, "query_id", "query", docs, "title", 10, {"body": 1.0})
        assert {(r.query_id, r.title, r["rank"], round(r.score, 9)) for r in found.collect()} == wanted
    assert not text_index.bm25_top(queries, "query_id", "query", docs.limit(0), "title", 10, {"body": 1.0}).collect()
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroups" in plan  # pairs of queries and documents are never rows


def test_entities_of_blocks_are_those_of_all_pairs(spark, monkeypatch):
    names = ["index", "Index", "map", "maps", "ab", "résumé", "a b c", "日本語", "x" * 60, None, "retry-limit"]
    titles = spark.createDataFrame([(n,) for n in names], "title string")
    asked = [(1, "the INDEX of maps"), (2, "the INDEX of maps"), (3, "RÉSUMÉ 日本語版"), (4, "ab"), (5, None), (6, "x" * 61), (7, "a b c retry-limits"), (1, "a b c"), (8, "nothing")]
    queries = spark.createDataFrame(asked, "query_id bigint, query string")
    wanted = {(k, t) for k, q in asked for t in names if q and t and len(t) >= 3 and len(q) >= 3 and t.lower() in q.lower()}
    for texts, size in ((16_384, 65_536), (2, 3)):
        monkeypatch.setattr(rules, "TEXTS", texts)
        monkeypatch.setattr(rules, "NAMES", size)
        found = rules.entities(queries, "query_id", "query", titles).collect()
        assert len(found) == len(wanted) and {tuple(r) for r in found} == wanted
    assert not rules.entities(queries, "query_id", "query", titles.limit(0)).collect()


def test_mentions_of_blocks_and_common_beginnings(spark, monkeypatch):
    names = [f"move-the-shard-{i}-later" for i in range(40)] + ["index", "a b", "café-map", "Retry-Limit"]
    titles = spark.createDataFrame([(n,) for n in names] + [(None,)], "title string")
    bodies = [(1, "Move the shard 7 later, or move-the-shard-8 sooner; see [[index]] and indexes."), (2, "CAFÉ map, retry\nlimit, a b"), (3, None), (4, "move the nothing")]
    notes = spark.createDataFrame(bodies, "note_id bigint, body string")
    wanted = {(k, *f) for k, b in bodies if b for f in links.cover(b, names)}
    assert {w[1] for w in wanted} == {"move-the-shard-7-later", "index", "café-map", "Retry-Limit", "a b"}
    for size, n in ((4_096, 65_536), (1, 10)):
        monkeypatch.setattr(links, "BODIES", size)
        monkeypatch.setattr(links, "NAMES", n)
        found = links.mentions(notes, "note_id", "body", titles).collect()
        assert len(found) == len(wanted) and {tuple(r) for r in found} == wanted
    met = links._said(pa.table({"key": [4, 1], "_low": ["move the nothing", bodies[0][1].lower()]}), pa.table({"title": names, "_t": [n.lower() for n in names]}))
    assert set(met.to_pylist()[i]["title"] for i in range(met.num_rows)) == {"move-the-shard-7-later", "index"}


def test_composite_memory_follows_the_tile_not_the_queries(monkeypatch):
    rnd = np.random.default_rng(1)
    notes, queries = 300, 900
    vec = lambda: pa.array(list(rnd.normal(size=(notes, 4))), pa.list_(pa.float32()))
    flat = ("temporal", "vitality", "low", "high", "community", *retrieval.INTENT_TYPES)
    batch = pa.RecordBatch.from_arrays([pa.array([f"n{i}" for i in range(notes)]), vec(), vec(), vec(), *(pa.array(rnd.random(notes)) for _ in flat)], ["title", "title_vec", "desc_vec", "body_vec", *flat])
    asked = SimpleNamespace(value=(pa.array(range(queries)), rnd.normal(size=(queries, 4)), ["semantic", "decision", None] * (queries // 3)))
    monkeypatch.setattr(retrieval, "TILE", 6_000)
    sizes = [b.num_rows for b in retrieval._scored(iter([batch.slice(0, 100), batch.slice(100)]), asked, None, 4)]
    assert sum(sizes) == notes * queries and max(sizes) <= 6_000
    best = [b.num_rows for b in retrieval._scored(iter([batch.slice(0, 100), batch.slice(100)]), asked, 5, 4)]
    assert sum(best) == 5 * queries  # one cut of a task, not one a batch


def test_composite_and_ranked_answer_all_queries(spark):
    wanted = {r[0] for r in search.table(spark, SF, "search_queries").select("query_id").collect()}
    notes = search.notes_of(spark, SF).count()
    assert len(wanted) > 300
    assert {r[0] for r in search.q_ranked(spark, SF).select("query_id").distinct().collect()} == wanted
    assert {tuple(r) for r in search.q_composite(spark, SF).groupBy("query_id").count().collect()} == {(q, notes) for q in wanted}
