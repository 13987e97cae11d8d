import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from notegraph.functions import codes, decay
from notegraph.functions.text import slug, tokens
from notegraph.operators import lifecycle, links, retrieval, rules
from notegraph.operators.fusion import _ring, explore, fold_boosts, fuse
from notegraph.sources import vault


def one(spark, column, **values):
    kinds = {str: "string", int: "bigint", float: "double"}
    schema = ", ".join(f"{k} {kinds.get(type(v), 'string')}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first().x


def test_tokens_and_slug(spark):
    assert one(spark, tokens(F.col("t")), t="The Éclair of a DB-2x, x") == ["clair", "db", "2x"]
    assert one(spark, tokens(F.col("t")), t=None) == []
    assert one(spark, slug(F.col("t")), t="  Use Redis, for: Cache!  ") == "use-redis-for-cache"


def test_vitality_of_hand_values(spark):
    v = decay.vitality(F.col("n"), F.col("d"), F.col("i"), F.lit(False), F.lit(0.0))
    assert one(spark, v, n=0, d=100.0, i=0) == pytest.approx(0.25)
    assert one(spark, v, n=0, d=100.0, i=2) == pytest.approx(0.3)
    bridge = decay.vitality(F.col("n"), F.col("d"), F.col("i"), F.lit(True), F.lit(0.0))
    assert one(spark, bridge, n=0, d=1.0, i=0) == 0.5
    assert one(spark, decay.zone(F.lit(None).cast("double"), F.lit("active")), n=0) == "archived"
    assert one(spark, decay.simple_decay(F.lit(None).cast("double")), n=0) is None


def test_bad_dates_leave_used_notes_without_vitality(spark):
    rows = [("bad", "active", 3, "yesterday"), ("bad-unused", "active", 0, "yesterday"), ("none", "active", 3, None), ("future", None, 5, "2030-01-01")]
    notes = spark.createDataFrame(rows, "title string, status string, access_count bigint, created string")
    empty = spark.createDataFrame([], "src string, dst string")
    found = {r.title: r for r in lifecycle.note_vitality(notes, empty, spark.createDataFrame([], "id string"), None, F.lit(vault.AS_OF)).collect()}
    assert found["bad"].vitality is None and found["bad"].zone == "archived"
    assert found["bad-unused"].vitality == pytest.approx(0.25)
    assert 0 < found["future"].vitality < 1
    assert sum(r.n for r in lifecycle.zone_counts(lifecycle.note_vitality(notes, empty, spark.createDataFrame([], "id string"), None, F.lit(vault.AS_OF))).collect()) == 4


@pytest.mark.parametrize("target", [1.0, 0.5, 0.8])
def test_closed_form_of_piecewise_cosines(spark, target):
    rnd = random.Random(3)
    rows = [(v,) for v in [0.0, 1.0, 0.125, 0.75, -1.0, 2.0, *(rnd.random() for _ in range(40))]]
    df = spark.createDataFrame(rows, "v double")
    both = df.select(codes.piecewise_cosine(F.col("v"), target).alias("a"), codes.cosine(codes.piecewise(F.col("v")), codes.piecewise(F.lit(target))).alias("b")).collect()
    assert all(abs(r.a - r.b) < 1e-9 for r in both)
    assert one(spark, codes.piecewise_cosine(F.lit(None).cast("double"), target), n=0) is None


def test_cosine_of_odd_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0]), ([0.0], [0.0]), (None, [1.0]), ([], []), ([1.0, 1.0], [1.0, 1.0])], "a array<float>, b array<float>")
    assert [round(r.c, 6) for r in df.select(codes.cosine(F.col("a"), F.col("b")).alias("c")).collect()] == [0, 0, 0, 0, 1]


def test_fold_is_clamped_in_order(spark):
    rows = [("a", "2024-01-01", 0.7), ("a", "2024-01-03", 0.6), ("a", "2024-01-02", 0.8), ("a", "2024-01-02", -3.0), ("b", None, 0.5), (None, "2024-01-01", 0.5), ("c", "2024-01-01", None)]
    df = spark.createDataFrame(rows, "k string, at string, b double").withColumn("at", F.to_timestamp("at"))
    found = fold_boosts(df, "k", "at", "b").collect()
    assert len(found) == 1 and found[0].boost == 1.0


def test_fold_of_a_hot_key_by_composition(spark):
    rnd = random.Random(4)
    rows = [("hot" if rnd.random() < 0.7 else f"k{rnd.randrange(5)}", rnd.choice([rnd.randrange(86_400 * 9), rnd.randrange(300)]), rnd.random() * 0.4) for _ in range(600)]
    rows += [("hot", 77, 0.1), ("hot", 77, 0.2)]
    df = spark.createDataFrame(rows, "k string, s bigint, b double").withColumn("at", F.timestamp_seconds("s"))
    wanted = {}
    for k, s, b in sorted(rows, key=lambda r: r[1]):
        v, t = wanted.get(k, (0.0, s))
        wanted[k] = min(1.0, v * math.exp(-0.1 * (s - t) / 86_400) + b), s
    for hot in ([], ["hot", "k1"]):
        found = {r.k: r.boost for r in fold_boosts(df, "k", "at", "b", hot=hot).collect()}
        assert found == pytest.approx({k: v for k, (v, _) in wanted.items()})


def test_ring_is_in_hash_order(spark):
    from hashlib import md5

    names = [f"note-{i}" for i in range(300)]
    found = {r.pick: r.place for r in _ring(spark.createDataFrame([(n,) for n in names], "title string"), "0").collect()}
    assert found == {n: i for i, n in enumerate(sorted(names, key=lambda n: (md5(f"{n}0".encode()).hexdigest(), n)))}


def test_fusion_and_exploration(spark):
    a = spark.createDataFrame([(1, "x", 0.9), (1, "y", 0.5)], "query_id bigint, title string, score double")
    b = spark.createDataFrame([(1, "y", 9.0)], "query_id bigint, title string, score double")
    fused = {r.title: r for r in fuse({"composite": a, "keyword": b}).collect()}
    assert fused["y"].score == pytest.approx(2 * 0.5 / 62 + 9.0 / 61) and fused["x"].keyword is None
    titles = spark.createDataFrame([("x",), ("y",), ("z",)], "title string")
    ranked = spark.createDataFrame([(1, "x", 0.9, 1), (2, "x", 0.9, 1), (2, "y", 0.8, 2)], "query_id bigint, title string, score double, rank int")
    out = explore(ranked, titles).collect()
    assert {(r.query_id, r.rank) for r in out} == {(1, 1), (2, 1), (2, 2)}
    assert [r.title for r in out if r.query_id == 2 and r.was_exploration] == ["z"]
    assert explore(ranked, titles.where("title <> 'z'")).where("was_exploration and query_id = 2").count() == 0
    assert explore(ranked, titles, 0).count() == 3


def test_intent_priority_and_confidence(spark):
    df = spark.createDataFrame([(1, "when did we, remember when"), (2, "how to, why did we"), (3, None), (4, "process"), (5, "reprocess")], "id int, q string")
    assert {r.id: (r.intent, r.confidence) for r in rules.classify_intent(df, "q").collect()} == {1: ("episodic", 1.0), 2: ("procedural", 0.7), 3: ("semantic", 0.5), 4: ("procedural", 0.7), 5: ("semantic", 0.5)}


def test_validation(spark):
    df = spark.createDataFrame([(1, "ok", "idea", ["a"], "x"), (2, " ", "odd", [], "A claim.")], "id int, status string, type string, tags array<string>, description string")
    found = {r.id: r for r in rules.validate(df, "id", ["status", "tags"], {"type": ["idea"], "tags": ["a"]}, 5).collect()}
    assert found[1].valid and not found[1].warnings
    assert found[2].errors == ["Missing required field: status", "Missing required field: tags", "Invalid type value: odd", "Description exceeds max length (5)"] and len(found[2].warnings) == 1


def test_entities_equal_brute_force(spark):
    rnd = random.Random(1)
    words = ["cache", "use-redis", "ab", "x-y-z", "éé-é", "index map", "Redis", "кеш", "холодный осколок данных", "笔记本", "use-redis-for"]
    asked = [(i, " ".join(rnd.choice(["use-redis", "cachet", "x-y-z", "ÉÉ-é", "the", "index map", "Кеш", "холодный осколок данных", "我的笔记本"]) for _ in range(3))) for i in range(30)] + [(99, None), (98, "")]
    found = {tuple(r) for r in rules.entities(spark.createDataFrame(asked, "id int, q string"), "id", "q", spark.createDataFrame([(w,) for w in words], "title string")).collect()}
    assert found == {(i, w) for i, q in asked if q for w in words if len(w) >= 3 and w.lower() in q.lower()}


def test_mentions_cover_longest_first(spark):
    notes = spark.createDataFrame([(1, "Use redis-for cache, see [[redis-for-cache]] and redis. Redistribute."), (2, None), (3, "")], "id int, body string")
    titles = spark.createDataFrame([("use-redis-for-cache",), ("redis",), ("redis-for-cache",), ("--",)], "title string")
    found = [(r.title, r.start, r.linked) for r in links.mentions(notes, "id", "body", titles).orderBy("start").collect()]
    assert found == [("use-redis-for-cache", 0, False), ("redis-for-cache", 27, True), ("redis", 49, False)]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab \n-#:[]RelevantNotesAreas", max_size=80), st.lists(st.sampled_from(["a", "b", "c"]), max_size=3), st.lists(st.sampled_from(["m", "n"]), max_size=2))
def test_footers_are_idempotent(body, areas, found):
    once = links.inject_footers(body, areas, found)
    assert links.inject_footers(once, areas, found) == once


def test_overlap_of_pairs_equals_filtered_overlap(spark):
    rnd = random.Random(2)
    rows = [(f"n{i}", [rnd.choice("abcdef") for _ in range(4)]) for i in range(30)] + [("none", None), ("nil", [None, "a"])]
    df = spark.createDataFrame(rows, "title string, tags array<string>")
    wanted = {tuple(r) for r in links.overlap(df, df, "tags").where("n >= 2").collect()}
    assert {tuple(r) for r in links.overlap(df, df, "tags", 2).collect()} == wanted


def test_promotion_gates_and_steps(spark):
    schema = "note_id bigint, title string, space string, description string, type string, status string, project array<string>, tags array<string>, body string, last_accessed string, access_count bigint"
    inbox = spark.createDataFrame(
        [
            (1, "new-claim", "inbox", "d", None, "inbox", ["p", "q"], ["t"], "We decided to keep the old claim.", None, None),
            (2, "stub", "inbox", "d", None, "inbox", [], [], "{Content — what}", None, 1),
            (3, "old-claim", "inbox", "d", None, "inbox", [], [], "x", None, 1),
            (4, "busy", "inbox", "d", None, "active", [], [], "x", None, 1),
        ],
        schema,
    )
    notes = spark.createDataFrame([(9, "old-claim", "notes", "d", "idea", "active", ["p", "q"], ["t"], "x", None, 1)], schema)
    titles = spark.createDataFrame([("old-claim",), ("p-map",), ("index",)], "title string")
    empty = spark.createDataFrame([], "src string, dst string")
    found = {r.title: r for r in links.promote(inbox, notes, titles, empty, {}, {}, "2024-01-01").collect()}
    assert {k: v.skipped for k, v in found.items()} == {"new-claim": None, "stub": "placeholder", "old-claim": "exists", "busy": "status"}
    new = found["new-claim"]
    assert (new.note_type, new.status, new.access_count, new.last_accessed) == ("decision", "active", 1, "2024-01-01")
    assert "[[old-claim]]." in new.body and new.areas == ["index", "p-map"] and new.body.endswith("Areas:\n- [[index]]\n- [[p-map]]\n")


@pytest.mark.parametrize(
    "text, has, data, body",
    [
        ("---\ntype: idea\ncreated: 2024-01-02\n---\nBody", True, '{"created": "2024-01-02", "type": "idea"}', "Body"),
        ("---\r\na: 1\r\n---\r\nx\r\ny", True, '{"a": 1}', "x\ny"),
        ("---\nnever closed", True, None, "---\nnever closed"),
        ("---\njust text\n---\nb", True, "{}", "b"),
        ("---\na: [1\n---\nb", True, None, "b"),
        ("no\r\nfrontmatter", False, None, "no\r\nfrontmatter"),
        ("", False, None, ""),
    ],
)
def test_frontmatter(text, has, data, body):
    pytest.importorskip("yaml")
    found = vault.frontmatter(text)
    assert (found[0], found[1], found[3]) == (has, data, body)


def test_markdown_folder_and_access_log(spark, tmp_path):
    (tmp_path / "v").mkdir()
    (tmp_path / "v" / "a note.md").write_text("---\nx: 1\n---\nhi")
    (tmp_path / "v" / "skip.txt").write_text("no")
    assert [r.title for r in vault.read_markdown(spark, str(tmp_path / "v")).collect()] == ["a note"]
    assert vault.read_markdown(spark, str(tmp_path / "nowhere")).count() == 0
    log = tmp_path / "log"
    log.mkdir()
    (log / "l.jsonl").write_text('{"timestamp": "t", "query": "q", "intent": "semantic", "results": [{"title": "a", "rank": 1, "score": 0.5, "propensity": 0, "wasExploration": false}]}\n\nnot json\n')
    events = vault.read_access_log(spark, str(log))
    assert events.count() == 1
    vault.append_access_log(events, str(log))
    assert vault.read_access_log(spark, str(log)).count() == 2


def test_embedding_and_neighbours(spark):
    df = spark.createDataFrame([(1, "cold shard retry"), (2, "cold shard"), (3, None), (4, "")], "id bigint, t string")
    v = retrieval.embed(df, "t", "vec", 32)
    assert [r.id for r in v.where("vec is null").orderBy("id").collect()] == [3, 4]
    found = retrieval.nearest_of(v.where("id = 1"), v, "id", "vec", 1, 32).collect()
    assert [(r.query, r.other) for r in found] == [(1, 2)]


def test_incremental_and_upsert(spark):
    new = spark.createDataFrame([("a", "x"), ("b", None)], "title string, body string")
    first = lifecycle.changed(new, spark.createDataFrame([], "title string, content_hash string"), "title", ["title", "body"])
    assert {r.state for r in first.collect()} == {"indexed"}
    assert {r.state for r in lifecycle.changed(new, first, "title", ["title", "body"]).collect()} == {"skipped"}
    assert {r.state for r in lifecycle.changed(new, first, "title", ["title", "body"], force=True).collect()} == {"indexed"}
    both = lifecycle.upsert(first, first.where("title = 'a'").withColumn("state", F.lit("again")), "title")
    assert {(r.title, r.state) for r in both.collect()} == {("a", "again"), ("b", "indexed")}


def test_entities_meet_without_a_product(spark):
    df = spark.createDataFrame([(1, "x")], "id int, q string")
    plan = rules.entities(df, "id", "q", df.select(F.col("q").alias("title")))._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def scored_by_hand(vectors, vec, intent):
    from notegraph.operators.rules import SPACE_WEIGHTS, SPLIT_WEIGHTS

    cos = lambda a, b: 0.0 if not a or not b or len(a) != len(b) or not any(a) or not any(b) else sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))
    text = sum(w * cos(vec, v) for w, v in zip(SPLIT_WEIGHTS[intent], vectors))
    return text * SPACE_WEIGHTS[intent][0]


def test_composite_in_blocks_and_cut(spark, monkeypatch):
    rnd = random.Random(6)
    draw = lambda: [rnd.choice([0.0, 1.0, -1.0]) for _ in range(4)]
    schema = "title string, title_vec array<float>, desc_vec array<float>, body_vec array<float>, community_vec array<float>, indexed_at timestamp"
    rows = [(f"n{i}", draw(), draw() if i % 3 else None, draw()[: 3 + i % 2], None, None) for i in range(30)] + [("gone", draw(), None, None, None, None)]
    vectors = spark.createDataFrame(rows, schema)
    facts = spark.createDataFrame([(f"n{i}", "x", 0.0, 0.0) for i in range(30)], "title string, type string, vitality double, pagerank double")
    asked = [(i, draw(), rnd.choice(["episodic", "semantic", "decision"])) for i in range(9)] + [(9, None, "procedural")]
    queries = spark.createDataFrame(asked, "query_id bigint, vec array<float>, intent string")
    wanted = {(i, r[0]): round(scored_by_hand(r[1:4], v, intent), 6) for i, v, intent in asked for r in rows[:30]}
    for size in (64_000_000, 8 * 4 * 2):
        monkeypatch.setattr(retrieval, "BROADCAST_BYTES", size)
        found = retrieval.composite(queries, vectors, facts, F.lit(vault.AS_OF), dims=4).collect()
        assert {(r.query_id, r.title): round(r.score, 6) for r in found} == wanted
        cut = {(r.query_id, r.title) for r in retrieval.composite(queries, vectors.coalesce(1), facts, F.lit(vault.AS_OF), 3, dims=4).collect()}
        for i in range(10):
            best = sorted((-wanted[i, r[0]], r[0]) for r in rows[:30])[:3]
            assert {(i, t) for _, t in best} <= cut


def test_queries_without_seed_share_one_run(spark):
    queries = spark.createDataFrame([(1,), (2,)], "query_id bigint")
    ranks = spark.createDataFrame([(1, "a", 0.9), (1, "b", 0.1), (None, "a", 0.2), (None, "c", 0.5), (None, "d", 0.1)], "query_id bigint, id string, rank_score double")
    found = {tuple(r) for r in retrieval.graph_signal(queries, ranks, None, 2).collect()}
    assert found == {(1, "a", 0.9), (1, "b", 0.1), (2, "c", 0.5), (2, "a", 0.2)}


def test_each_search_spreads_by_itself(spark):
    result = spark.createDataFrame([(1, "a", 0.02, 1), (2, "a", 0.02, 1), (2, "b", 0.02, 2), (3, "x", 0.0, 1)], "query_id bigint, title string, score double, rank int")
    edges = spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string")
    found = {(r.query_id, r.title): round(r.boost, 6) for r in retrieval.boosts_of(result, edges).collect()}
    assert found == {(1, "b"): 0.012, (2, "b"): 0.012, (2, "a"): 0.012, (2, "c"): 0.012}
