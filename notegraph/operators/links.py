"""Mentions of titles in bodies, link suggestions, footers, areas, and the promotion of inbox notes."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from notegraph.operators.blocks import block_pairs, blocks
from notegraph.operators.graph import both_ways
from notegraph.operators.rules import classify_type, detect_projects
from notegraph.session import cut_lineage

#: Suggestions from this confidence on are applied without asking.
AUTO_APPLY = 0.8
HEADINGS = ("Relevant Notes", "Areas")


#: Bodies and titles that meet in one group of :func:`mentions`.
BODIES, NAMES = 4_096, 65_536


def mentions(notes: DataFrame, key: str, body: str, titles: DataFrame) -> DataFrame:
    """``(key, title, start, length, linked)``: mentions of titles in bodies, longest titles first, without overlap.

    A dash of a title matches a dash or white space; case does not count; borders are those of ASCII words. Candidates
    are the titles whose words stand in a body in their order without others between: bodies meet titles block by block
    and look up runs of words under their first one, so common beginnings of titles bring nothing together. The greedy
    cover runs per body over its own candidates. ``linked`` tells mentions inside ``[[ ]]``. ``start`` is 0-based.
    """
    named = cut_lineage(titles.select("title", F.lower("title").alias("_t")).where("title is not null").distinct())
    texts = notes.where(F.col(body).isNotNull()).select(F.col(key).alias("key"), F.lower(body).alias("_low"))
    kind = notes.schema[key].dataType.simpleString()
    met = block_pairs(texts, "key", blocks(notes.count(), BODIES), named, "title", blocks(named.count(), NAMES), _said, f"key {kind}, title string")
    candidates = met.groupBy("key").agg(F.collect_set("title").alias("titles"))
    rows = candidates.join(notes.select(F.col(key).alias("key"), F.col(body).alias("body")), "key").select("key", "body", "titles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for k, text, names in zip(*(c.to_pylist() for c in batch.columns)):
                for title, start, length, linked in cover(text, names):
                    for column, value in zip(out, (k, title, start, length, linked)):
                        column.append(value)
            kinds = (batch.schema.field(0).type, pa.string(), pa.int32(), pa.int32(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, kinds)], ["key", "title", "start", "length", "linked"])

    return rows.mapInArrow(run, f"key {kind}, title string, start int, length int, linked boolean").withColumnRenamed("key", key)


def _said(texts: pa.Table, titles: pa.Table) -> pa.Table:
    """The titles of a block whose words stand one after another in each body."""
    names, lengths = {}, {}
    for title, low in zip(titles["title"].to_pylist(), titles["_t"].to_pylist()):
        if words := re.findall("[a-z0-9_]+", low):
            names.setdefault(" ".join(words), []).append(title)
            lengths.setdefault(words[0], set()).add(len(words))
    row, found = [], []
    for i, low in enumerate(texts["_low"].to_pylist()):
        words, hits = re.findall("[a-z0-9_]+", low), set()
        for at, word in enumerate(words):
            for n in lengths.get(word, ()):
                if at + n <= len(words) and (run := " ".join(words[at : at + n])) in names:
                    hits.add(run)
        for run in hits:
            found += names[run]
            row += [i] * len(names[run])
    return pa.table({"key": texts["key"].take(pa.array(row, pa.int64())), "title": pa.array(found, pa.string())})


#: White space as a dash, ASCII capitals as small letters: place by place.
_FLAT = {c: "-" for c in range(0x3001) if chr(c).isspace()} | {c: chr(c + 32) for c in range(65, 91)}


def _places(body: str, flat: str | None, title: str) -> Iterator[tuple[int, int]]:
    """Where a title stands in a body, left to right. An ASCII title without blanks is looked for in the flat body; a
    pattern, which costs its compilation, is for the others."""
    if flat is None or not title.isascii() or any(c.isspace() for c in title):
        pattern = r"[-\s]".join(re.escape(part) for part in title.split("-"))
        for m in re.finditer(rf"(?<![A-Za-z0-9_]){pattern}(?![A-Za-z0-9_])", body, re.I):
            yield m.span()
        return
    low, at = title.lower(), 0
    while low and (at := flat.find(low, at)) >= 0:
        end = at + len(low)
        if (at == 0 or flat[at - 1] not in _WORD) and flat[end : end + 1] not in _WORD:
            yield at, end
            at = end
        else:
            at += 1


_WORD = frozenset("abcdefghijklmnopqrstuvwxyz0123456789_")


def cover(body: str, titles: list[str]) -> list[tuple[str, int, int, bool]]:
    """Non-overlapping mentions in one body, longest title first (ties: the lesser title), by place."""
    taken = bytearray(len(body) + 1)
    found = []
    flat = None if any(c in body for c in "\u017f\u212a\u0130\u0131") else body.translate(_FLAT)  # letters that patterns take for s, k and i
    for title in sorted(set(titles), key=lambda t: (-len(t), t)):
        for start, end in _places(body, flat, title):
            if not any(taken[start:end]):
                taken[start:end] = b"\1" * (end - start)
                found.append((title, start, end - start, body.rfind("[[", 0, start) > body.rfind("]]", 0, start)))
    return sorted(found, key=lambda f: f[1])


def apply_mentions(body: str, found: list[tuple[str, int, int, bool]]) -> str:
    """Wraps what is not yet linked, from the end, so that places stay valid."""
    for title, start, length, linked in sorted(found, key=lambda f: -f[1]):
        if not linked:
            body = f"{body[:start]}[[{title}]]{body[start + length:]}"
    return body


def overlap(targets: DataFrame, others: DataFrame, values: str, least: int = 1) -> DataFrame:
    """``(title, other, n)``: shared distinct values of an array column between target notes and all notes.

    With ``least`` 2 or 3 only notes that share so many meet at all: the join is on pairs or triples of values, not on
    single ones, so a value that most notes have brings nobody together by itself.
    """

    def keyed(df: DataFrame, name: str) -> DataFrame:
        own = F.array_sort(F.array_distinct(F.filter(values, lambda v: v.isNotNull())))
        keys = F.transform(own, lambda v: F.array(v))
        for _ in range(least - 1):
            keys = F.flatten(F.transform(keys, lambda k: F.transform(F.filter(own, lambda v: v > F.element_at(k, -1)), lambda v: F.concat(k, F.array(v)))))
        return df.select(F.col("title").alias(name), own.alias(f"_{name}"), F.explode(F.transform(keys, lambda k: F.array_join(k, "\x1f"))).alias("k"))

    met = keyed(targets, "title").join(keyed(others, "other"), "k").where("title <> other")
    if least == 1:
        return met.groupBy("title", "other").agg(F.count(F.lit(1)).alias("n"))
    return met.select("title", "other", F.size(F.array_intersect("_title", "_other")).cast("bigint").alias("n")).distinct()


def triangles(links: DataFrame, edges: DataFrame) -> DataFrame:
    """``(title, other, confidence)``: notes that link to what a note mentions (0.5) or that it links on to (0.45)."""
    co = links.join(edges.select(F.col("dst").alias("via"), F.col("src").alias("other")), "via").withColumn("confidence", F.lit(0.5))
    on = links.join(edges.select(F.col("src").alias("via"), F.col("dst").alias("other")), "via").withColumn("confidence", F.lit(0.45))
    near = co.unionByName(on).where("title <> other").groupBy("title", "other").agg(F.max("confidence").alias("confidence"))
    return near.join(links.select("title", F.col("via").alias("other")), ["title", "other"], "left_anti")


def suggest(targets: DataFrame, notes: DataFrame, edges: DataFrame, found: DataFrame, sure: bool = False) -> DataFrame:
    """``(title, other, reason, confidence)``: the first reason that applies of mention 0.9, shared projects
    0.6 + 0.1 n, shared tags 0.5 + 0.1 n, a shared neighbour 0.5 or 0.45. ``found`` holds the targets' mentions.

    With ``sure`` only what reaches ``AUTO_APPLY`` is looked for: mentions, two shared projects, three shared tags.
    """
    new = found.where(~F.col("linked")).select(F.col("note").alias("title"), F.col("title").alias("other")).distinct()
    tenth = F.lit(0.1)
    parts = [
        (new.withColumn("confidence", F.lit(0.9)), "title-match", 1),
        (overlap(targets, notes, "project", 2 if sure else 1).withColumn("confidence", F.lit(0.6) + F.col("n") * tenth).drop("n"), "project-overlap", 2),
        (overlap(targets, notes, "tags", 3 if sure else 1).withColumn("confidence", F.lit(0.5) + F.col("n") * tenth).drop("n"), "tag-overlap", 3),
        (triangles(new.select("title", F.col("other").alias("via")), edges), "shared-neighborhood", 4),
    ]
    out = None
    for df, reason, order in parts[:3] if sure else parts:
        one = df.select("title", "other", F.struct(F.lit(order).alias("o"), F.lit(reason).alias("reason"), F.col("confidence").alias("confidence")).alias("s"))
        out = one if out is None else out.unionByName(one)
    return out.where("title <> other").groupBy("title", "other").agg(F.min("s").alias("s")).select("title", "other", "s.reason", "s.confidence")


def areas(projects: DataFrame, titles: DataFrame, routing: dict[str, str], default: str = "index") -> DataFrame:
    """``(title, areas)``: per project its routed map, else the least map title that contains it, else the default."""
    maps = titles.where(F.lower("title").contains("map")).select(F.col("title").alias("area")).distinct()
    names = projects.select(F.explode("project").alias("p")).distinct()
    routed = F.lit(None).cast("string")
    for name, area in routing.items():
        routed = F.when(F.col("p") == name, area).otherwise(routed)
    # Maps are met by their tokens; a project of several tokens by its first.
    tokens = maps.select("area", F.explode(F.array_distinct(F.split(F.lower("area"), "[^a-z0-9]+"))).alias("t"))
    hits = names.withColumn("t", F.element_at(F.split(F.lower("p"), "[^a-z0-9]+"), 1)).join(tokens, "t").where(F.lower("area").contains(F.lower("p")))
    named = names.join(hits.groupBy("p").agg(F.min("area").alias("hit")), "p", "left").select("p", F.coalesce(routed, F.col("hit"), F.lit(default)).alias("area"))
    per = projects.select("title", F.explode_outer("project").alias("p")).join(named, "p", "left")
    return per.groupBy("title").agg(F.array_sort(F.collect_set(F.coalesce("area", F.lit(default)))).alias("areas"))


def parse_footer(body: str, heading: str) -> list[str]:
    """Titles of the list under a footer heading (``## Heading`` or ``Heading:``), in order."""
    lines = body.split("\n")
    for form in (rf"##\s+{re.escape(heading)}\s*", rf"{re.escape(heading)}:\s*"):
        for at, line in enumerate(lines):
            if re.fullmatch(form, line):
                items = []
                for rest in map(str.strip, lines[at + 1 :]):
                    if rest.startswith("- "):
                        if m := re.match(r"-\s+\[\[([^\]]+)\]\]", rest):
                            items.append(m[1])
                    elif rest.startswith(("#", "---")) or rest in {f"{h}:" for h in HEADINGS}:
                        break
                return items
    return []


def strip_footers(body: str) -> str:
    """A body without its footer sections: a heading, and the list items and blank lines after it."""
    kept, inside = [], False
    for line in body.split("\n"):
        bare = line.strip()
        if any(bare == f"## {h}" or bare.startswith(f"{h}:") for h in HEADINGS):
            inside = True
        elif not inside or not (bare == "" or bare.startswith("- ")):
            inside = False
            kept.append(line)
    return "\n".join(kept).rstrip()


def inject_footers(body: str, more_areas: list[str], more_links: list[str]) -> str:
    """Footers merged with those that are there and written once: doing it twice changes nothing."""
    merged = [list(dict.fromkeys([*parse_footer(body, h), *more])) for h, more in zip(HEADINGS, (more_links, more_areas))]
    parts = [f"\n\n{h}:" + "".join(f"\n- [[{t}]]" for t in titles) for h, titles in zip(HEADINGS, merged) if titles]
    return strip_footers(body) + "".join(parts) + "\n"


def promote(inbox: DataFrame, notes: DataFrame, titles: DataFrame, edges: DataFrame, keywords: dict[str, list[str]], routing: dict[str, str], today: str, default: str = "index") -> DataFrame:
    """The inbox notes as promoted rows, and why others are not: ``(title, skipped, note_type, project, areas, links,
    body, status, last_accessed, access_count)``.

    Gates: status ``inbox``, a body that is not the template's stub, no note of that title. Then type, projects (own
    ones, else detected), mentions wrapped in the body, suggestions of high confidence, areas, footers. All notes of a
    batch see the vault as it was before it.
    """
    there = notes.select("title", F.lit(True).alias("_there")).distinct()
    rows = inbox.join(there, "title", "left")
    skipped = F.when(F.coalesce("status", F.lit("")) != "inbox", "status").when(F.col("body").rlike(r"\{Content\s*[-—]"), "placeholder").when(F.col("_there"), "exists")
    rows = classify_type(rows.withColumn("_name", F.translate("title", "-", " ")), "_name", "body", "type").withColumn("skipped", skipped)
    found_projects = detect_projects(F.concat_ws("\n", "_name", "body"), keywords)
    rows = rows.withColumn("project", F.when(F.size("project") > 0, F.col("project")).otherwise(found_projects))
    ready = rows.where("skipped is null")
    found = mentions(ready, "title_key", "body", titles) if "title_key" in ready.columns else mentions(ready.withColumnRenamed("title", "note"), "note", "body", titles)
    applied = suggest(ready, notes, edges, found, sure=True).where(F.col("confidence") >= AUTO_APPLY)
    links = applied.groupBy("title").agg(F.array_sort(F.collect_set("other")).alias("links"))
    spots = found.groupBy(F.col("note").alias("title")).agg(F.collect_list(F.struct("title", "start", "length", "linked")).alias("spots"))
    full = rows.join(areas(ready.select("title", "project"), titles, routing, default), "title", "left").join(links, "title", "left").join(spots, "title", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = []
            for body, skip, area, link, spot in zip(*(batch.column(c).to_pylist() for c in ("body", "skipped", "areas", "links", "spots"))):
                found = [(s["title"], s["start"], s["length"], s["linked"]) for s in spot or []]
                bodies.append(body if skip else inject_footers(apply_mentions(body or "", found), area or [], link or []))
            yield pa.RecordBatch.from_arrays([batch.column("title"), pa.array(bodies, pa.string())], ["title", "body"])

    done = full.select("title", "body", "skipped", "areas", "links", "spots").mapInArrow(run, "title string, body string")
    live = F.col("skipped").isNull()
    return full.drop("body", "spots").join(done, "title").select(
        "title", "skipped", "note_type", "project", "areas", "links", "body", F.when(live, "active").otherwise(F.col("status")).alias("status"),
        F.when(live, today).otherwise(F.col("last_accessed")).alias("last_accessed"), (F.coalesce("access_count", F.lit(0)) + live.cast("int")).alias("access_count"),
    )


def near_titles(spread: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` nearest of scored pairs ``(title, other, similarity)`` above 0.5, with confidence at most 0.95."""
    w = W.partitionBy("title").orderBy(F.round("similarity", 9).desc(), "other")
    best = spread.where("similarity > 0.5").withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k)
    return best.select("title", "other", F.least(F.lit(0.95), "similarity").alias("confidence"))


__all__ = [n for n in dir() if not n.startswith("_")] + ["both_ways"]
