"""A vault of files as tables, its settings, captured notes."""

import pytest
from pyspark.sql import functions as F

from notegraph.functions.text import inbox_name, is_first_run
from notegraph.operators.graph import link_scan
from notegraph.sources import config, vault


def test_index_and_links_of_a_folder(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "a claim.md").write_text("---\ndescription: about [[b]]\nproject: [p, q]\naccess_count: 3\ncreated: 2024-01-02\n---\nSee [[c|label]].")
    (tmp_path / "scalar.md").write_text("---\nproject: p\naccess_count: many\n---\nx")
    (tmp_path / "open.md").write_text("---\nnever closed [[b]]")
    (tmp_path / "plain.md").write_text("no frontmatter")
    (tmp_path / "empty.md").write_text("")
    (tmp_path / "c++ 100%.md").write_bytes(b"\xff ok")
    found = {r.title: r for r in vault.note_index(spark, str(tmp_path)).collect()}
    assert set(found) == {"a claim", "scalar", "open", "plain", "c++ 100%"}
    a = found["a claim"]
    assert (a.description, a.project, a.access_count, a.created, a.body) == ("about [[b]]", ["p", "q"], 3, "2024-01-02", "See [[c|label]].")
    assert found["scalar"].project is None and found["scalar"].access_count is None and found["open"].status is None
    edges = {tuple(r) for r in link_scan(vault.note_index(spark, str(tmp_path)), "title", "content").collect()}
    assert edges == {("a claim", "b"), ("a claim", "c|label"), ("open", "b")}
    assert vault.note_index(spark, str(tmp_path / "nowhere")).count() == 0


def test_store_can_be_replaced_from_itself(spark, tmp_path):
    folder = str(tmp_path)
    assert vault.index_status(spark, folder)["exists"] is False
    vault.write_store(spark.createDataFrame([("a", 1)], "title string, n int"), folder, "note_vectors")
    vault.write_store(vault.table(spark, folder, "note_vectors").withColumn("n", F.col("n") + 1), folder, "note_vectors")
    vault.write_store(spark.createDataFrame([("model", "m")], "key string, value string"), folder, "meta")
    status = vault.index_status(spark, folder)
    assert status["notes"] == 1 and status["model"] == "m" and status["bytes"] > 0 and vault.table(spark, folder, "note_vectors").first().n == 2


def test_capture(spark):
    rows = [(1, "Use the cold cache", None, "Body"), (2, "Use the cold cache!", "idea", None), (3, "short", None, None), (4, None, None, None), (5, "Use the cold cache", None, ""), (6, "\u0445\u043e\u043b\u043e\u0434\u043d\u044b\u0439 \u043a\u0435\u0448 \u0434\u0430\u043d\u043d\u044b\u0445", None, None)]
    asked = spark.createDataFrame(rows, "id bigint, title string, type string, content string")
    taken = spark.createDataFrame([("use-the-cold-cache",), ("use-the-cold-cache-3",), (None,)], "title string")
    found = {r.id: r for r in vault.capture(asked, "id", "# {Title}\n\n{Content}\n", "2024-01-01", taken).collect()}
    assert {k: (r.fault, r.title) for k, r in found.items()} == {
        1: (None, "use-the-cold-cache-2"), 2: (None, "use-the-cold-cache-4"), 3: ("one word", None), 4: ("empty", None), 5: (None, "use-the-cold-cache-5"), 6: (None, "note-6"),
    }
    assert found[1].body == "# Use the cold cache\n\nBody\n" and found[5].body.endswith("{Content}\n") and found[2].note_type == "idea"


def test_names_and_first_run(spark):
    df = spark.createDataFrame([("My note", "bot"), ("My note", ""), ("My note", None)], "t string, a string")
    assert [r.x for r in df.select(inbox_name(F.col("t"), F.col("a")).alias("x")).collect()] == ["bot-my-note.md", "my-note.md", "my-note.md"]
    texts = [(None,), ("",), ("---\na: 1\n---\n# Head\n\n<!-- fill\nme -->\n",), ("# Head\n<!-- First session: x -->\nI am",), ("# Head\nI am",)]
    assert [r.x for r in spark.createDataFrame(texts, "t string").select(is_first_run(F.col("t")).alias("x")).collect()] == [True, True, True, True, False]


def test_config(tmp_path):
    pytest.importorskip("yaml")
    assert config.load_config(str(tmp_path / "none.yaml")) == config.DEFAULTS
    path = tmp_path / "c.yaml"
    path.write_text("vitality:\n  decay:\n    idea: 7\n  zone_thresholds:\n    stale_floor: 0.4\nretrieval:\n  default_limit: 3\nbm25:\n")
    found = config.load_config(str(path))
    assert found["vitality"]["decay"] == {"idea": 7} and found["vitality"]["zone_thresholds"] == {"active_floor": 0.6, "stale_floor": 0.4, "fading_floor": 0.1}
    assert found["retrieval"]["default_limit"] == 3 and found["bm25"] == config.DEFAULTS["bm25"] and config.DEFAULTS["vitality"]["decay"] == {}
    path.write_text("vault:\n  version: ''\nvitality:\n  base: high\n")
    with pytest.raises(ValueError, match="vault.version is required, vitality.base must be a number"):
        config.load_config(str(path))
