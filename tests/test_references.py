import datetime as dt

from notegraph.operators.references import orphan_references, orphan_report, parent_keys

NOTES = "title string, added_at timestamp, removed_at timestamp"
REFS = "override_id bigint, links array<string>, promoted_at timestamp, title string"
D = dt.datetime


def run(spark, refs):
    notes = spark.createDataFrame([("kept-note", D(2024, 1, 1), None), ("gone-note", D(2024, 1, 1), D(2024, 3, 1)), ("late-note", D(2024, 9, 1), None), (None, D(2024, 1, 1), None)], NOTES)
    maps = spark.createDataFrame([("Tooling Map", D(2024, 1, 1))], "title string, added_at timestamp")
    parents = parent_keys((notes, "title", "added_at", "removed_at"), (maps, "title", "added_at", None))
    return orphan_references(spark.createDataFrame(refs, REFS), "override_id", "links", "promoted_at", parents)


def test_states_and_written_forms(spark):
    at = D(2024, 5, 1)
    links = [" [[Kept Note|label]] ", "notes/kept-note.md", "kept-note#part", "tooling-map", "gone-note", "Late Note", "nothing", "nothing", "", "  ", None, "[[ ]]"]
    found = run(spark, [(1, links, at, "x"), (1, links, at, "x"), (2, None, at, "y"), (3, [], at, "z"), (4, ["gone-note"], None, "z"), (5, ["nothing"], None, "z")])
    assert {(r.override_id, r.link, r.state) for r in found.collect()} == {(1, "gone-note", "deleted"), (1, "Late Note", "late"), (1, "nothing", "missing"), (5, "nothing", "missing")}
    assert {(r.period, r.state): r.n for r in orphan_report(found, "t", "promoted_at").collect()} == {("2024-05", "deleted"): 1, ("2024-05", "late"): 1, ("2024-05", "missing"): 1, (None, "missing"): 1}


def test_removal_at_the_moment_counts_as_deleted(spark):
    assert [r.state for r in run(spark, [(1, ["gone-note"], D(2024, 3, 1), "x")]).collect()] == ["deleted"]
    assert run(spark, [(1, ["late-note"], D(2024, 9, 1), "x")]).count() == 0


def test_empty_tables(spark):
    assert run(spark, []).count() == 0
