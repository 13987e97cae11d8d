import math
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from notegraph.llm import markup, packing, residue, truncation
from notegraph.llm.distinctiveness import most_characteristic, residual_idf
from notegraph.llm.rank_fusion import fused_top, reciprocal_rank_fusion
from notegraph.llm.text_quality import STATISTICS, classify_documents, document_statistics, statistics
from notegraph.llm.tokenizer import ByteBpe, count_tokens, encode_corpus
from notegraph.llm.vector_search import exact_neighbours, fit_tree, grafted, nearest, neighbour_pairs

SIGNALS = ["a", "b"]


def scores(spark, rows):
    return spark.createDataFrame(rows, "q bigint, t string, a double, b double, rank int")


def rrf(rows, k=60):
    """Brute force: ranks by counting."""
    best = {}
    for q, t, a, b, _ in rows:
        if q is None or t is None:
            continue
        real = [None if v is None or math.isnan(v) else v for v in (a, b)]
        old = best.get((q, t), [None, None])
        best[q, t] = [x if y is None else y if x is None else max(x, y) for x, y in zip(old, real)]
    out = {}
    for (q, t), own in best.items():
        total, n = 0.0, 0
        for j, v in enumerate(own):
            if v is not None:
                total += 1 / (k + 1 + sum(1 for (p, _), o in best.items() if p == q and o[j] is not None and o[j] > v))
                n += 1
        if n:
            out[q, t] = (round(total, 12), n)
    return out


def fusion_rows():
    rnd = random.Random(4)
    rows = [(rnd.randrange(4), f"t{rnd.randrange(30)}", rnd.choice([None, float("nan"), 0.1 * rnd.randrange(5)]), rnd.choice([None, 1000.0 * rnd.randrange(6)]), 0) for _ in range(150)]
    return rows + rows[:20] + [(None, "x", 1.0, 1.0, 0), (1, None, 1.0, 1.0, 0), (9, "none", None, None, 0)]


@pytest.mark.parametrize("hot", [[], [0, 1]])
def test_rank_fusion_against_counting(spark, hot):
    rows = fusion_rows()
    found = {(r.q, r.t): (round(r.fused, 12), r.n_signals) for r in reciprocal_rank_fusion(scores(spark, rows), "q", "t", SIGNALS, hot=hot).collect()}
    assert found == rrf(rows)


@pytest.mark.parametrize("hot", [[], [0, 1]])
def test_fused_top_and_limits(spark, hot):
    rows = fusion_rows()
    limits = spark.createDataFrame([(0, 2), (1, 3), (2, None), (3, 1), (3, 1), (None, 4)], "q bigint, n int")
    fused = reciprocal_rank_fusion(scores(spark, rows), "q", "t", SIGNALS, hot=hot)
    found = {(r.q, r.t) for r in fused_top(fused, limits, "q", "t", "n", hot).collect()}
    wanted = set()
    for q, n in ((0, 2), (1, 3), (3, 1)):
        wanted |= {(q, t) for _, t in sorted((-v[0], t) for (p, t), v in rrf(rows).items() if p == q)[:n]}
    assert found == wanted
    assert reciprocal_rank_fusion(scores(spark, []), "q", "t", SIGNALS).count() == 0


def test_residual_idf(spark):
    rows = [("common", f"n{i}", 1.0) for i in range(20)] + [("burst", "n0", 8.0), ("burst", "n1", 9.0), ("once", "n0", 1.0), ("bad", "n0", None), ("nan", "n0", float("nan")), (None, "n0", 1.0)]
    df = spark.createDataFrame(rows + rows[:5], "term string, title string, tf double")
    found = {(r.term, r.title): r for r in residual_idf(df, "term", "title", "tf").collect()}
    n, df_, cf = 20, 2, 17.0
    assert found["burst", "n0"].ridf == pytest.approx(-math.log2(df_ / n) + math.log2(1 - math.exp(-cf / n)))
    assert found["burst", "n1"].score > found["burst", "n0"].score > found["once", "n0"].score >= found["common", "n0"].score
    assert found["bad", "n0"].tf == 0 and found["nan", "n0"].score == 0 and len(found) == 25
    best = most_characteristic(residual_idf(df, "term", "title", "tf"), "term", "title", least_terms=2)
    assert {(r.title, r.term) for r in best.collect()} == {("n0", "burst"), ("n1", "burst")}
    assert residual_idf(df.limit(0), "term", "title", "tf").count() == 0


@pytest.fixture(scope="module")
def bpe():
    return ByteBpe.load()


@pytest.fixture(scope="module")
def reference():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return t


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("aabcdest 's\n\t-_.,0123 "), st.characters(blacklist_categories=["Cs"])), max_size=60))
def test_ids_are_those_of_the_public_tokenizer(bpe, reference, text):
    assert bpe.encode(text) == reference.encode(text, add_special_tokens=False).ids


def test_whole_corpus_and_defined_ids(spark, bpe, reference):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for r in encode_corpus(df, "doc_id", "text").join(df.select("doc_id", "text"), "doc_id").collect():
        assert r.ids == (reference.encode(r.text, add_special_tokens=False).ids if r.text else [])
    odd = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, " ", 0), (4, "x" * 300_000, 0), (5, "<|endoftext|>", 0)], "doc_id bigint, text string, ids int")
    found = {r.doc_id: r.ids for r in encode_corpus(odd, "doc_id", "text").collect()}
    assert found[1] == found[2] == [] and bytes(b"".join(bpe.text[i] for i in found[4])) == b"x" * 300_000 and 50256 not in found[5]
    assert {r.doc_id: r.n_tokens for r in count_tokens(odd, "doc_id", "text").collect()} == {k: len(v) for k, v in found.items()}
    assert encode_corpus(odd.limit(0), "doc_id", "text").count() == 0


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(0, 200), max_size=12))
def test_plan_places_every_item_within_capacity(histogram):
    slots, containers = packing.plan(histogram, 40)
    room = Counter()
    for s in slots:
        for i in range(s.count):
            at = s.container + i // s.per
            assert room[at] == s.start + (i % s.per) * s.length
            room[at] += s.length
    assert Counter({n: sum(s.count for s in slots if s.length == n) for n in histogram}) == Counter(histogram)
    assert all(v <= 40 for v in room.values()) and set(room) == set(range(containers))
    assert containers == best_fit_decreasing(histogram, 40)


def best_fit_decreasing(histogram, capacity):
    """Item by item: the tightest open container that holds it, else a new one."""
    rooms = []
    for length in sorted((k for k, v in histogram.items() for _ in range(v)), reverse=True):
        fits = [i for i, r in enumerate(rooms) if r >= length]
        if fits:
            rooms[min(fits, key=rooms.__getitem__)] -= length
        else:
            rooms.append(capacity - length)
    return len(rooms)


def test_packing_divides_only_what_exceeds_the_capacity(spark):
    sizes = [(1, 25), (2, 7), (3, 0), (4, None), (5, 10), (6, 3), (7, 3), (8, 4), (None, 5), (9, 40)] + [(100 + i, 5) for i in range(50)]
    df = spark.createDataFrame(sizes + sizes[:3], "k bigint, n bigint")
    budgets = spark.createDataFrame([(1, 10), (2, 100), (3, None)], "b bigint, capacity int")
    rows = packing.pack(df, "k", "n", budgets, "b", "capacity").collect()
    for b, cap in ((1, 10), (2, 100)):
        mine = [r for r in rows if r.b == b]
        spans = {}
        for r in mine:
            spans.setdefault(r.container_id, []).append((r.start, r.start + r.n_tokens))
        for parts in spans.values():
            parts = sorted(p for p in parts if p[1] > p[0])
            assert all(x[1] <= y[0] for x, y in zip(parts, parts[1:])) and (not parts or parts[-1][1] <= cap)
        for k, n in {k: n or 0 for k, n in sizes if k is not None}.items():
            own = sorted(r.part for r in mine if r.k == k)
            assert own == list(range(len(own))) and len(own) == max(1, -(-n // cap)) and sum(r.n_tokens for r in mine if r.k == k) == n
    assert len({r.b for r in rows}) == 2
    assert packing.pack(df.limit(0), "k", "n", budgets, "b", "capacity").count() == 0
    assert packing.fill_report(packing.pack(df, "k", "n", budgets, "b", "capacity"), budgets, "b", "capacity").count() == 2


def vectors(n=900, dim=24, seed=2):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 9, dim))
    x = centres[rng.integers(0, len(centres), n)] + 0.25 * rng.normal(size=(n, dim))
    x[700:] = x[0]  # copies
    return x.astype("f4")


def test_vector_search_recall_copies_and_bad_vectors(spark):
    x = vectors()
    rows = [(i, v.tolist(), "x") for i, v in enumerate(x)]
    rows += [(2000, None, "x"), (2001, [0.0] * 24, "x"), (2002, [float("nan")] + [1.0] * 23, "x"), (2003, [1.0] * 12, "x"), (None, x[1].tolist(), "x")]
    df = spark.createDataFrame(rows, "id bigint, v array<float>, cosine string").repartition(5)
    found = nearest(df, "id", ["v"], 5, 24, sample_rows=400, bucket_rows=200).collect()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    sims = unit @ unit.T
    np.fill_diagonal(sims, -2)
    floor = -np.sort(-sims, axis=1)[:, 4]
    by = Counter(r.id for r in found)
    assert set(by) == set(range(len(x))) and set(by.values()) == {5}
    assert np.mean([sims[r.id, r.neighbour] >= floor[r.id] - 1e-3 for r in found]) >= 0.95
    split = nearest(df, "id", ["v"], 5, 24, sample_rows=400, bucket_rows=200, split_rows=8, split_sample=64).collect()
    assert set(Counter(r.id for r in split).values()) == {5} and np.mean([sims[r.id, r.neighbour] >= floor[r.id] - 1e-3 for r in split]) >= 0.95
    pairs = neighbour_pairs(nearest(df, "id", ["v"], 5, 24)).collect()
    assert all(r.note_id_a < r.note_id_b for r in pairs) and len(pairs) == len(set(pairs))
    exact = exact_neighbours(df, "id", "v", 100, 5, 24).collect()
    assert {r.id for r in exact} == set(range(0, 900, 100)) and all(sims[r.id, r.neighbour] >= floor[r.id] - 1e-5 for r in exact)
    assert nearest(df.limit(0), "id", ["v"], 5, 24).count() == 0
    few = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.1])], "id bigint, v array<float>")
    assert {(r.id, r.neighbour) for r in nearest(few, "id", ["v"], 5, 2).collect()} == {(1, 2), (2, 1)}


def test_grafted_trees_keep_their_leaves_apart():
    x = vectors()[:400].astype("f4")
    tree = fit_tree(x, 100)
    parts = tree.home(tree.distances(x))
    whole = grafted(tree, {0: fit_tree(x[parts == 0], 10), 1: fit_tree(x[parts == 1], 10)})
    assert sorted(n for n in whole.leaf if n >= 0) == list(range(whole.leaves)) and whole.leaves > tree.leaves
    home = whole.home(whole.distances(x))
    for leaf in range(whole.leaves):
        assert len(set(parts[home == leaf])) <= 1
    assert [sorted(order) for order in whole.search(whole.distances(x[:5]), whole.leaves)] == [list(range(whole.leaves))] * 5


@pytest.mark.parametrize(
    "text, kinds",
    [
        ("Fish &amp; chips", {"html"}), ("<p>One<br>two", {"html"}), ("<!-- note -->x", {"html"}), ("a < b and c > d", set()), ("R&D; Q&A", set()), ("<your name here> <<SLOT>>", set()),
        ("# Title\n\ntext", {"markdown"}), ("Title\n=====\n\nx", {"markdown"}), ("- item", {"markdown"}), ("1. first\n2. second", {"markdown"}), ("**bold** and _thin_", {"markdown"}),
        ("5 * 3 * 2 or 4 ** 2", set()), ("snake_case_name", set()), ("`code`", {"markdown"}), ("> quoted", {"markdown"}), ("a -> b", set()), ("[t](u.md)", {"markdown"}), ("![t](u.png)", {"markdown"}),
        ("| a | b |\n|---|---|\n| 1 | 2 |", {"markdown"}), ("Version 2 | build 3", set()), ("~~gone~~", {"markdown"}), ("proxy~mode", set()), ("f(x) = t[i][j]", set()), ("#no heading", set()),
        ("[[a|b]]", {"wiki"}), ("[https://x.invalid label]", {"wiki"}), ("== Head ==", {"wiki"}), ("'''bold'''", {"wiki"}), ("the team's 'own'", set()), ('{| class="x"\n! a !! b\n|-\n| 1 || 2\n|}', {"wiki"}),
        (r"\emph{x}", {"latex"}), (r"\begin{itemize}\item a\end{itemize}", {"latex"}), (r"$\frac{a}{b}$", {"latex"}), (r"\( x^2 \)", {"latex"}), ("from $5 to $7 each", set()), (r"C:\vault\notes\x.txt", set()),
        ("```\n<b>[[x]]</b> $a^2$\n```", {"markdown"}), ("<pre><code># no\n== no ==</code></pre>", {"html"}), ("`[[x]] <b>`", {"markdown"}), ("\\begin{verbatim}\n# no [[x]]\n\\end{verbatim}", {"latex"}),
        ("{{ slot }} %SLOT% ${HOME}", set()), ("", set()),
    ],
)
def test_kinds_of_markup(text, kinds):
    assert markup.parse(text).kinds == kinds


def test_clean_text_keeps_structure(spark):
    body = "# Head\r\n\r\nSome **bold** [[note|label]] and $x^2$.\r\n\r\n- one\r\n- two\r\n\r\n```py\nx = 1\n```\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n<h2>Next</h2><p>Text &amp; more</p>"
    df = spark.createDataFrame([(1, body, "k"), (2, None, "k"), (3, "", "k"), (4, "x" * 200_000, "k"), (None, "a", "k")], "id bigint, body string, kinds string")
    found = {r.id: r for r in markup.clean_markup(df, "id", "body").collect()}
    assert found[1].text == "# Head\n\nSome bold label and $x^2$.\n\n- one\n- two\n\n```\nx = 1\n```\n\na | b\n1 | 2\n\n## Next\n\nText & more"
    assert found[2].text is None and found[2].kinds == [] and found[3].text == "" and len(found[4].text) == 200_000 and None not in found
    assert markup.clean_markup(df.limit(0), "id", "body").count() == 0


def test_tag_paths_drop_menus():
    long = "This is a long paragraph, with commas, and with stops. It says something of its own."
    page = "<div><nav>Home</nav><nav>About</nav><nav>Help</nav></div><div><p>" + "</p><p>".join([long] * 4) + "</p></div>"
    text = markup.clean_text(markup.parse(page))
    assert "long paragraph" in text and "Home" not in text


def test_menus_and_footers_go_and_structure_stays():
    long = "This is a long paragraph, with commas, and with stops. It says something of its own."
    menu = "<nav><ul><li><a href='/'>Home</a></li><li><a href='/a'>About</a></li><li><a href='/h'>Help</a></li></ul></nav>"
    main = "<div><h1>Title of it</h1><p>" + "</p><p>".join([long] * 4) + "</p><ul><li>first thing</li><li>second thing</li></ul><p>As $x^2$</p><table><tr><td>76</td><td>b</td></tr></table><pre>a = 1</pre></div>"
    side = "<section><ul><li><a href=x>One</a></li><li><a href=y>Two</a></li><li><a href=z>Three</a></li></ul></section>"
    parsed = markup.parse(menu + main + side + "<footer><p>Imprint Contact</p></footer>")
    text = markup.clean_text(parsed)
    assert not any(w in text for w in ("Home", "About", "Help", "One", "Two", "Three", "Imprint"))
    assert all(w in text for w in ("# Title of it", long, "- first thing", "- second thing", "$x^2$", "76", "```\na = 1\n```"))
    assert markup.content_nodes(parsed.nodes).count(False) == 7


def test_lists_of_links_outside_boxes_stay():
    body = "<ul><li><a href=x>One</a></li><li><a href=y>Two</a></li><li><a href=z>Three</a></li></ul>\n\n" + "A sentence, and more of it. " * 5
    assert markup.clean_text(markup.parse(body)).startswith("- One\n- Two\n- Three")


@pytest.mark.parametrize(
    "body, kind",
    [
        ("{{title}}", "placeholder"), ("Good text here.\n\nNext: [Insert summary here]", "placeholder"), ("Dear {first_name}, your {product} is ready.", "placeholder"), ("Lorem ipsum dolor sit amet consectetur adipiscing elit.", "filler"),
        ("This is sample text for the page. This is sample text for the page.", "filler"), ("404 Not Found", "error"), ('{"error": {"status": 503, "message": "Service Unavailable"}}', "error"),
        ("Oops! We can't find that page. It may have been moved or deleted.", "error"), ("Please enable JavaScript to view this page.", "script"), ("<noscript>Switch scripts on.</noscript>", "script"),
        ("The renderer expands `{{title}}` before saving.", None), ("```\n{{ slot }}\n```\n\nThat is the template.", None), ("We answer 404 Not Found for unknown keys and log them once.", None),
        ("Three vaults contained lorem ipsum, and that is how we found it.", None), ("Set ${HOME} before the run.", None), ("Readers who have JavaScript disabled still get the list.", None), ("", None), (None, None), (" \n ", None),
    ],
)
def test_residue(body, kind):
    assert residue.residue_kind(body) == kind


def test_recurrent_lines_are_subtracted_by_host(spark):
    rows = [(i, f"Please enable JavaScript to view this page.\n\nText number {i} of the note.", "a") for i in range(100)] + [(200, "Please enable JavaScript to view this page.", "b"), (201, None, None), (202, "{{x}}", None)]
    df = spark.createDataFrame(rows + rows[:2], "id bigint, body string, host string")
    found = {r.id: r.residue for r in residue.find_residue(df, "id", "body", "host").collect()}
    assert len(found) == 103 and {k for k, v in found.items() if v} == {200, 202}
    assert residue.find_residue(df.limit(0), "id", "body", "host").count() == 0


def sentences(n, seed=3):
    rnd = random.Random(seed)
    nouns, verbs, ends = "garden bridge window kitchen painter letter".split(), "closes opens repairs keeps".split(), ["near the river", "before the winter", "for the old teacher", "without a plan"]
    return [f"The {rnd.choice(nouns)} of the {rnd.choice(nouns)} {rnd.choice(verbs)} every {rnd.choice(nouns)} {rnd.choice(ends)}" for _ in range(n)]


def test_truncation_on_held_out_cuts(spark):
    rnd = random.Random(9)
    rows, cut = [], set()
    for i, s in enumerate(sentences(1500)):
        if i % 10 == 0:
            s = s[: rnd.randrange(len(s) // 2, len(s) - 5)].rstrip() + rnd.choice(["", "", "...", "…"])
            if s.rstrip(".…").split()[-1] in ("river", "winter", "teacher", "plan"):
                s = s[:-2]
            cut.add(i)
        elif i % 10 < 6:
            s += "."
        rows.append((i, s, rnd.choice(["Alpha", "alpha ", None]), 1.0))
    rows += [(9000, None, "alpha", 1.0), (9001, "", "alpha", 1.0), (9002, "  ", None, 1.0), (None, "The x", "alpha", 1.0)]
    df = spark.createDataFrame(rows + rows[:5], "id bigint, text string, source string, p_cut double")
    found = {r.id: r.is_cut for r in truncation.score_truncation(df, "id", "text", "source").collect()}
    assert set(found) == set(range(1500))
    hits = sum(found[i] for i in cut)
    assert hits / len(cut) > 0.9 and sum(v for k, v in found.items() if k not in cut) / 1350 < 0.03
    assert truncation.score_truncation(df.limit(0), "id", "text", "source").count() == 0


def test_text_statistics_edges(spark):
    assert statistics(None) is statistics("") is statistics(" \n​"[:2]) is None
    s = dict(zip(STATISTICS, statistics("One two three.\nFour five.")))
    assert (s["n_words"], s["n_lines"], s["punct_line_share"], s["words_per_line"]) == (5, 2, 1.0, 2.5)
    df = spark.createDataFrame([(1, None, "a"), (2, "", "a"), (3, "word " * 100_000, "a"), (None, "x", "a")], "id bigint, text string, n_words string")
    found = {r.id: r for r in document_statistics(df, "id", "text").collect()}
    assert found[1].n_words is None and found[3].n_words == 100_000 and len(found) == 3


def test_kinds_of_documents(spark):
    good = "The bridge was closed because the river had risen, and nobody in the village could remember such a flood. When the water fell, we walked along the bank and counted what was left."
    rows = [(i, good + f" It was the {i}th time." if i % 3 else "We went to the lake in the evening, and it was cold.") for i in range(60)]
    rows += [(100, "- apples\n- pears\n- old bread\n- two lamps\n- rope"), (101, "| a | b | c |\n| --- | --- | --- |\n| 1 | 20% | x |\n| 4 | 7% | y |"), (102, " ".join(str(i * 7919) for i in range(80))), (103, None), (104, " ")]
    found = {r.id: r.kind for r in classify_documents(spark.createDataFrame(rows, "id bigint, text string"), "id", "text").collect()}
    assert {found[i] for i in range(60)} == {"prose"} and (found[100], found[101], found[102], found[103], found[104]) == ("list", "table", "junk", None, None)
    assert classify_documents(spark.createDataFrame([], "id bigint, text string"), "id", "text").count() == 0


def test_partitions_do_not_change_fusion(spark):
    df = scores(spark, fusion_rows())
    results = [{tuple(r) for r in reciprocal_rank_fusion(df.repartition(n), "q", "t", SIGNALS).select("q", "t", F.round("fused", 12)).collect()} for n in (1, 6)]
    assert results[0] == results[1]
