"""Cases that a cut in an operator would leave out."""

import random

from notegraph.llm import residue, truncation


def kinds(spark, rows):
    df = spark.createDataFrame(rows, "id bigint, body string, host string")
    return {r.id: r.residue for r in residue.find_residue(df, "id", "body", "host").collect()}


def test_copies_of_one_page_are_residue_however_many(spark):
    own = [(i, f"A claim of its own, number {i}: {'abcdefghij'[i % 10] * 3}{i // 10}.", "a") for i in range(120)]
    pages = ["Oops! We can't find that page.", "{{summary}}", "Lorem ipsum dolor sit amet consectetur adipiscing elit."]
    copies = [(1000 + i, pages[i % 3], "a") for i in range(180)]
    found = kinds(spark, own + copies)
    assert {k for k, v in found.items() if v} == {k for k, _, _ in copies}


def test_unfilled_lines_are_residue_in_many_distinct_notes(spark):
    words = "amber birch cedar delta ember flint grove heron".split()
    rows = [(i, f"The {words[i % 8]} of the {words[i // 8 % 8]} stays where it was.\n\n{{{{summary}}}}", "a") for i in range(64)]
    rows += [(500 + i, f"Oops! We can't find that page.\n\nRequest id: {i}", "b") for i in range(60)]
    assert all(kinds(spark, rows).values())


def test_the_share_decides_in_spaces_of_any_size(spark):
    notice = "Please enable JavaScript to view this page."
    for n in (40, 200):
        rows = [(i, f"The note {'x' * (i + 1)} says something of its own." + (f"\n\n{notice}" if i % 10 == 0 else ""), "a") for i in range(n)]
        assert not any(kinds(spark, rows).values())


def test_lines_served_to_many_notes_are_residue_though_no_list_has_them(spark):
    own = [(i, f"The claim {'abcdefghij'[i % 10] * 3} {'klmnopqrst'[i // 10 % 10] * 4} stands on the page.", "a") for i in range(100)]
    notice = "The gatekeeper of this website wants another look"
    given = [(1000 + i, f"A note of its own, {'uvwxyz'[i % 6] * (i + 1)}.\n\n{notice}", "a") for i in range(4)]
    inside = [(2000, f"He said: the gatekeeper of this website wants another look at it, {'q' * 5}.", "a")]
    once = [(3000, "A note.\n\nThe doorman of this website wants another look", "a")]
    assert {k for k, v in kinds(spark, own + given + inside + once).items() if v} == {k for k, _, _ in given}


def test_recurrent_lines_joined_by_host_where_they_are_many(spark, monkeypatch):
    rows = [(i, f"Relevant notes:\n{{{{summary}}}}\n\nText {'x' * i}", "a") for i in range(40)] + [(100 + i, f"Relevant notes:\nPlain text {'y' * i}", None) for i in range(40)]
    few = kinds(spark, rows)
    monkeypatch.setattr(residue, "BROADCAST_LINES", 0)
    assert kinds(spark, rows) == few and sum(v is not None for v in few.values()) == 40


def test_fences_that_recur_still_mark_code():
    fenced = "Text.\n\n```\n{{ slot }}\n```\n\nMore text."
    assert residue.residue_kind(fenced, frozenset({"```"})) is None


def test_blocks_of_any_length_are_searched():
    css = "\n".join(f".part-{i} {{ margin: {i}px; padding: {i}px; }}" for i in range(300))
    page = f"<!DOCTYPE html>\n<html><head><style>\n{css}\n</style><title>502 Bad Gateway</title></head>\n<body><h1>502</h1></body></html>"
    shell = f"<noscript>You need scripts to run this app.</noscript>\n<style>\n{css}\n</style>\n<div id=root></div>"
    notice = "Checking your browser before you continue. Please enable JavaScript and cookies to go on. " + "If you still see this page, check that your browser is supported and reload the site. " * 4
    template = "\n".join([f"A line that is filled, number {i}" for i in range(60)] + ["Summary: {{summary}}"])
    parts = "\n\n".join(["<html><head>", "<style>a { b: c }</style>", "<meta>", "<title>404 Not Found</title></head>", "<body>", "</body></html>"])
    assert [residue.residue_kind(x) for x in (page, shell, notice, template, parts)] == ["error", "script", "script", "placeholder", "error"]


def test_long_text_about_notices_is_none():
    prose = "Please enable JavaScript in your browser is what the old page said. " + "The renderer waits for the queue, then writes every note and its links to the index in one go. " * 6
    page = "<noscript>Scripts are off.</noscript> " + "The rest of the block is a note of its own, and it goes on for a while. " * 4
    assert residue.residue_kind(prose) is None and residue.residue_kind(page) is None


def test_copies_of_a_cut_text_are_not_learnt_as_complete(spark):
    rnd = random.Random(3)
    nouns, verbs, ends = "garden bridge window kitchen painter letter".split(), "closes opens repairs keeps".split(), ["near the river", "before the winter", "for the old teacher", "without a plan"]
    rows = [(i, f"The {rnd.choice(nouns)} of the {rnd.choice(nouns)} {rnd.choice(verbs)} every {rnd.choice(nouns)} {rnd.choice(ends)}" + ("." if i % 2 else ""), "alpha") for i in range(1200)]
    cuts = ["The painter of the bridge repairs every", "The letter of the garden keeps every kitchen near the", "The window of the bri"]
    copies = [(5000 + i, cuts[i % 3], "beta") for i in range(600)]
    df = spark.createDataFrame(rows + copies, "id bigint, text string, source string")
    found = {r.id: r.is_cut for r in truncation.score_truncation(df, "id", "text", "source").collect()}
    assert all(found[k] for k, _, _ in copies) and sum(found[k] for k, _, _ in rows) < 0.03 * len(rows)
