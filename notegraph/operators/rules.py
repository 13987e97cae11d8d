"""Rules over texts: intent, note type, projects, titles, schema, entities."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from notegraph.functions.text import BLANK, matches, slug, tokens
from notegraph.operators.blocks import block_pairs, blocks
from notegraph.session import cut_lineage

# The patterns of the intents and types, in order of priority, and the weights of each intent.
INTENTS = {
    "episodic": [r"\bwhen\s+did\b", r"\blast\s+time\b", r"\bwhat\s+happened\b", r"\brecently\b", r"\bhistory\s+of\b", r"\btimeline\b", r"\bwhen\s+was\b", r"\bremember\s+when\b"],
    "procedural": [r"\bhow\s+to\b", r"\bsteps?\s+for\b", r"\bprocess\b", r"\bprocedure\b", r"\binstructions?\b", r"\bworkflow\b", r"\bhow\s+do\b", r"\bguide\b"],
    "decision": [r"\bwhy\s+did\s+we\b", r"\bdecision\b", r"\bchose\b", r"\bchoose\b", r"\balternatives?\b", r"\btrade-?off\b", r"\brationale\b", r"\bdecided\b"],
}
TYPES = {
    "decision": [r"\bchose\s+\w+\s+over\b", r"\bdecided\s+to\b", r"\bswitched\s+from\b", r"\bwill\s+use\b", r"\bapproved\b", r"\bgo\s+with\b", r"\bdecision\b", r"\btrade-?off\b", r"\balternatives?\b", r"\brationale\b"],
    "blocker": [r"\bblocked?\b", r"\bblocker\b", r"\bstuck\b", r"\bcan'?t\s+proceed\b", r"\bcannot\s+proceed\b", r"\bwaiting\s+on\b", r"\bdepends\s+on\b"],
    "opportunity": [r"\bopportunity\b", r"\bpotential\b", r"\bmight\s+enable\b", r"\bopens\s+up\b", r"\bworth\s+exploring\b", r"\bgap\b", r"\bnobody\s+has\b", r"\bmarket\s+for\b"],
    "learning": [r"\blearned\b", r"\bdiscovered\s+that\b", r"\bturns\s+out\b", r"\brealized\b", r"\btil\b", r"\bkey\s+takeaway\b", r"\bproves\b"],
    "idea": [r"\bwhat\s+if\b", r"\bcould\s+we\b", r"\bproposal\b", r"\bhypothesis\b", r"\bexperiment\b", r"\bidea\b"],
}
NOTE_TYPES = ["idea", "decision", "learning", "insight", "blocker", "opportunity"]
STATUSES = ["inbox", "active", "completed", "superseded", "archived"]
SPACE_WEIGHTS = {  # text, temporal, vitality, importance, type, community
    "episodic": (0.40, 0.25, 0.15, 0.05, 0.05, 0.10),
    "procedural": (0.30, 0.05, 0.10, 0.30, 0.10, 0.15),
    "semantic": (0.65, 0.05, 0.10, 0.10, 0.05, 0.05),
    "decision": (0.30, 0.15, 0.10, 0.10, 0.30, 0.05),
}
SPLIT_WEIGHTS = {"episodic": (0.2, 0.2, 0.6), "procedural": (0.3, 0.3, 0.4), "semantic": (0.5, 0.3, 0.2), "decision": (0.4, 0.4, 0.2)}  # title, description, body
SPACES = ["text", "temporal", "vitality", "importance", "type", "community"]
SPLITS = ["title", "description", "body"]


def classify_intent(queries: DataFrame, text: str) -> DataFrame:
    """Adds ``intent`` and ``confidence``: the intent most of whose patterns match, the first listed of equals, else
    semantic; 1 for two matches, 0.7 for one, 0.5 for none. Null and empty queries are semantic."""
    counted = queries
    for name, patterns in INTENTS.items():
        counted = counted.withColumn(f"_{name}", matches(F.col(text), patterns))
    most = F.greatest(*[F.col(f"_{n}") for n in INTENTS])
    choice = F.when(most == 0, "semantic")
    for name in INTENTS:
        choice = choice.when(F.col(f"_{name}") == most, name)
    level = F.when(most >= 2, 1.0).when(most == 1, 0.7).otherwise(0.5)
    return counted.withColumns({"intent": choice, "confidence": level}).drop(*[f"_{n}" for n in INTENTS])


def weight(intent: Column, table: dict, names: list[str], name: str) -> Column:
    """A weight of an intent as a column; unknown intents weigh as semantic."""
    place = names.index(name)
    out = F.lit(table["semantic"][place])
    for key, values in table.items():
        if key != "semantic":
            out = F.when(intent == key, values[place]).otherwise(out)
    return out


def classify_type(notes: DataFrame, title: str, body: str, given: str) -> DataFrame:
    """Adds ``note_type`` and ``type_confidence``: a valid given type is high; else the first type with a matching
    pattern (two high, one medium), else insight, low."""
    text = F.lower(F.concat_ws("\n", F.coalesce(F.col(title), F.lit("")), F.coalesce(F.col(body), F.lit(""))))
    counted = notes.withColumn("_text", text)
    for name, patterns in TYPES.items():
        counted = counted.withColumn(f"_{name}", matches(F.col("_text"), patterns, ""))
    kind, level = F.when(F.col(given).isin(NOTE_TYPES), F.col(given)), F.when(F.col(given).isin(NOTE_TYPES), "high")
    for name in TYPES:
        kind, level = kind.when(F.col(f"_{name}") > 0, name), level.when(F.col(f"_{name}") > 1, "high").when(F.col(f"_{name}") > 0, "medium")
    return counted.withColumns({"note_type": kind.otherwise("insight"), "type_confidence": level.otherwise("low")}).drop("_text", *[f"_{n}" for n in TYPES])


def detect_projects(text: Column, keywords: dict[str, list[str]]) -> Column:
    """Sorted names of the projects one of whose keywords a text contains, letter case aside."""
    low = F.lower(F.coalesce(text, F.lit("")))
    hits = []
    for name, words in keywords.items():
        any_of = [low.contains(w.lower()) for w in words]
        found = any_of[0]
        for more in any_of[1:]:
            found = found | more
        hits.append(F.when(found, name))
    return F.array_sort(F.filter(F.array(*hits), lambda x: x.isNotNull())) if hits else F.array().cast("array<string>")


def title_fault(title: Column) -> Column:
    """Why a title is no prose claim: ``empty``, ``uuid``, ``one word``, ``short``; null if it is one."""
    text = F.regexp_replace(F.coalesce(title, F.lit("")), f"^{BLANK}+|{BLANK}+$", "")
    uuid = text.rlike(r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")
    return F.when(text == "", "empty").when(uuid, "uuid").when(~text.contains(" "), "one word").when(F.length(text) < 10, "short")


def unique_slugs(df: DataFrame, key: str, title: str) -> DataFrame:
    """``(key, slug)``: the second and later rows of a slug, in order of the key, get ``-2``, ``-3``, ..."""
    rows = df.select(key, F.when(F.length(slug(F.col(title))) > 0, slug(F.col(title))).otherwise(F.concat(F.lit("note-"), F.col(key).cast("string"))).alias("_slug"))
    n = F.row_number().over(W.partitionBy("_slug").orderBy(key))
    return rows.withColumn("_n", n).select(key, F.when(F.col("_n") > 1, F.concat_ws("-", "_slug", F.col("_n").cast("string"))).otherwise(F.col("_slug")).alias("slug"))


def _outside(values: Column, allowed: list[str]) -> Column:
    return F.filter(values, lambda x: ~x.isin(allowed))


def blank(value: Column) -> Column:
    return value.isNull() | (F.length(F.regexp_replace(value.cast("string"), f"{BLANK}+", "")) == 0)


def validate(notes: DataFrame, key: str, required: list[str], enums: dict[str, list[str]], max_description: int = 200) -> DataFrame:
    """``(key, valid, errors, warnings)``: missing required fields, values outside the allowed, too long descriptions;
    a warning for a description that ends in a period. Array fields are checked item by item."""
    kinds = dict(notes.dtypes)
    errors = []
    for f in required:
        missing = F.col(f).isNull() | (F.size(f) == 0) if kinds[f].startswith("array") else blank(F.col(f))
        errors.append(F.when(missing, f"Missing required field: {f}"))
    for f, allowed in enums.items():
        if kinds[f].startswith("array"):
            wrong = _outside(F.col(f), allowed)
            errors.append(F.when(F.size(wrong) > 0, F.concat(F.lit(f"Invalid {f} values: "), F.array_join(wrong, ", "))))
        else:
            errors.append(F.when(~blank(F.col(f)) & ~F.col(f).isin(allowed), F.concat(F.lit(f"Invalid {f} value: "), F.col(f))))
    errors.append(F.when(F.length("description") > max_description, f"Description exceeds max length ({max_description})"))
    warnings = [F.when(F.trim("description").endswith("."), "Description should not end with a period")]
    said = [F.filter(F.array(*x), lambda e: e.isNotNull()) for x in (errors, warnings)]
    return notes.select(key, (F.size(said[0]) == 0).alias("valid"), said[0].alias("errors"), said[1].alias("warnings"))


#: Texts and titles that meet in one group of :func:`entities`.
TEXTS, NAMES = 16_384, 65_536


def entities(queries: DataFrame, key: str, text: str, titles: DataFrame) -> DataFrame:
    """``(key, title)``: titles of three characters or more that a query contains, letter case aside, no word borders.

    Distinct texts are searched once, and only then are their queries joined. Texts meet titles block by block: a title
    stands under its first three characters, and of those that begin at a place of the text only the lengths that occur
    there are looked up. Scripts make no difference.
    """
    low = titles.where(F.length("title") >= 3).select("title", F.lower("title").alias("_t")).where(F.length("_t") >= 3).distinct()
    low = cut_lineage(low)
    q = queries.where(F.length(text) >= 3).groupBy(key).agg(F.array_sort(F.collect_set(F.lower(text))).alias("_texts"))
    q = cut_lineage(q)
    texts = q.select("_texts").distinct()
    found = block_pairs(texts, "_texts", blocks(texts.count(), TEXTS), low, "title", blocks(low.count(), NAMES), _named, "_texts array<string>, titles array<string>")
    return q.join(found, "_texts").select(key, F.explode("titles").alias("title"))


def _named(texts: pa.Table, titles: pa.Table) -> pa.Table:
    """The titles of a block that each of its lists of texts contains."""
    names, lengths = {}, {}
    for title, low in zip(titles["title"].to_pylist(), titles["_t"].to_pylist()):
        names.setdefault(low, []).append(title)
        lengths.setdefault(low[:3], set()).add(len(low))
    lengths = {head: sorted(own) for head, own in lengths.items()}
    row, found = [], []
    for i, several in enumerate(texts["_texts"].to_pylist()):
        hits = set()
        for text in several:
            for at in range(len(text) - 2):
                for n in lengths.get(text[at : at + 3], ()):
                    if at + n > len(text):
                        break
                    if (low := text[at : at + n]) in names:
                        hits.add(low)
        if hits:
            row.append(i)
            found.append([title for low in hits for title in names[low]])
    return pa.table({"_texts": texts["_texts"].take(pa.array(row, pa.int64())).cast(pa.list_(pa.string())), "titles": pa.array(found, pa.list_(pa.string()))})


__all__ = [n for n in dir() if not n.startswith("_")] + ["tokens"]
