"""Queries on single notes: lifecycle, rules, codes, index state, files."""

from __future__ import annotations

from pyspark.sql import functions as F

from notegraph.functions import codes, decay
from notegraph.functions.text import inbox_name, slug, title_of_path
from notegraph.operators import graph as g
from notegraph.operators import lifecycle, links, rules
from notegraph.operators.fusion import fold_boosts
from notegraph.plans.graph import BOTH, EDGES, HUBS, IDS, INDEG, MEDIAN, TITLES, communities_sql, links_of, notes_of, pagerank_sql, titles_of
from notegraph.session import cut_lineage
from notegraph.sources.vault import AS_OF, capture, parse_frontmatter, table, write_frontmatter


def now():
    """The time of the fixed queries, as a column."""
    return F.lit(AS_OF)

#: Months by which event times are moved, to end shortly before the fixed time.
EVENT_MONTHS = 16
#: Days of decay of the types that have their own, for the simple decay.
DECAY_DAYS = {"decision": 90.0, "idea": 14.0}
#: The keywords of two invented projects, for the detection query.
KEYWORDS = {"storage": ["cache", "backup", "shard"], "reading": ["reader", "digest"], "search": ["ranker", "index"]}


def boosts_table(spark, folder):
    """``(title, boost)`` of notes, folded from the events: the user of an event stands for the note of that id, and its
    time lies 16 months before the fixed time's months."""
    at = F.col("ts") + F.expr(f"interval {EVENT_MONTHS} months")
    events = table(spark, folder, "events").select("user_id", at.alias("at"), (F.col("value") / 5000.0).alias("b"))
    folded = fold_boosts(events, "user_id", "at", "b")
    left = decay.decayed_boost(F.col("boost"), decay.days_between(F.col("updated"), now()))
    live = folded.select(F.col("user_id").alias("note_id"), left.alias("boost")).where(F.col("boost") >= 0.001)
    return notes_of(spark, folder).select("title", "note_id").join(live, "note_id").select("title", "boost")


def lively_of(spark, folder, boosted=True):
    """Vitality of all notes, all four rules of bridges protecting them; with ``boosted``, boosts added."""
    notes, edges = notes_of(spark, folder), cut_lineage(links_of(spark, folder))
    bridges = cut_lineage(g.bridges(notes, edges).select("id").distinct())
    return lifecycle.note_vitality(notes, edges, bridges, boosts_table(spark, folder) if boosted else None, now())


def q_vitality(spark, folder):
    return lively_of(spark, folder).select("title", F.round("vitality", 6).alias("vitality"), "in_degree", "zone")


def q_zone_counts(spark, folder):
    return lifecycle.zone_counts(lively_of(spark, folder)).select("zone", F.col("n").cast("bigint").alias("n"))


def q_fading(spark, folder):
    return lifecycle.fading(lively_of(spark, folder)).select("title", F.round("vitality", 6).alias("vitality"))


def q_by_vitality(spark, folder):
    best = lively_of(spark, folder).where("vitality is not null").orderBy(F.round("vitality", 9).desc(), "title").limit(10)
    return best.select("title", F.round("vitality", 6).alias("vitality"))


def q_archive(spark, folder):
    return lifecycle.to_archive(notes_of(spark, folder), links_of(spark, folder), now())


def q_archive_applied(spark, folder):
    notes = notes_of(spark, folder)
    return lifecycle.with_status(notes, q_archive(spark, folder), "archived").groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def q_prune(spark, folder):
    return lifecycle.prune_candidates(lively_of(spark, folder)).select("title", "zone", "in_degree", F.round("vitality", 6).alias("vitality"))


def q_hotspots(spark, folder):
    spots = lifecycle.hotspots(lively_of(spark, folder), g.communities(links_of(spark, folder)))
    return spots.select("community", "size", F.round("mean_vitality", 6).alias("mean_vitality"), F.array_join("top_members", "|").alias("top_members"))


def q_simple_decay(spark, folder):
    days = decay.days_between(lifecycle.created_at(F.coalesce("last_accessed", "created")), now())
    own = decay.decay_days_of(F.col("type"), DECAY_DAYS)
    return notes_of(spark, folder).select("title", F.round(decay.simple_decay(days, 1.0, own), 6).alias("vitality")).where("vitality is not null")


def q_revival(spark, folder):
    """The time from the first to the next use stands for that since a new connection."""
    days = decay.days_between(F.col("removed_at"), F.col("added_at"))
    return notes_of(spark, folder).select("title", F.round(decay.revival(days), 6).alias("revival"), F.round(decay.saturation(F.coalesce("access_count", F.lit(0))), 6).alias("saturation"))


def q_boost_fold(spark, folder):
    events = table(spark, folder, "events").select("user_id", "ts", (F.col("value") / 100.0).alias("b"))
    return fold_boosts(events, "user_id", "ts", "b").select("user_id", F.round("boost", 6).alias("boost"), F.date_format("updated", "yyyy-MM-dd HH:mm:ss").alias("updated"))


def q_boost_decay(spark, folder):
    events = table(spark, folder, "events")
    days = decay.days_between(F.col("ts"), F.lit("2024-02-01 00:00:00"))
    live = events.select("user_id", decay.decayed_boost(F.col("value") / 100.0, days).alias("b")).where("b >= 0.001")
    return live.groupBy("user_id").agg(F.round(F.sum("b"), 6).alias("boost"))


def q_intent(spark, folder):
    q = table(spark, folder, "search_queries").drop("intent")
    return rules.classify_intent(q, "query").select("query_id", "intent", "confidence")


def q_weights(spark, folder):
    q = rules.classify_intent(table(spark, folder, "search_queries").drop("intent"), "query")
    spaces = [rules.weight(F.col("intent"), rules.SPACE_WEIGHTS, rules.SPACES, s).alias(s) for s in rules.SPACES]
    splits = [rules.weight(F.col("intent"), rules.SPLIT_WEIGHTS, rules.SPLITS, s).alias(f"split_{s}") for s in rules.SPLITS]
    return q.select("intent", *spaces, *splits).distinct()


def q_entities(spark, folder):
    return rules.entities(table(spark, folder, "search_queries"), "query_id", "query", titles_of(spark, folder).union(table(spark, folder, "term_freqs").select("term")))


def q_type(spark, folder):
    return rules.classify_type(notes_of(spark, folder), "title", "body", "type").select("note_id", "note_type", "type_confidence")


def q_type_untyped(spark, folder):
    notes = notes_of(spark, folder).withColumn("none", F.lit(None).cast("string"))
    return rules.classify_type(notes, "title", "body", "none").select("note_id", "note_type", "type_confidence")


def q_projects(spark, folder):
    found = rules.detect_projects(F.concat_ws("\n", F.col("title"), F.col("body")), KEYWORDS)
    return notes_of(spark, folder).select("note_id", F.array_join(found, ",").alias("projects"))


def q_title_fault(spark, folder):
    return table(spark, folder, "search_queries").select("query_id", rules.title_fault(F.col("query")).alias("fault"))


def q_inbox_name(spark, folder):
    asked = table(spark, folder, "search_queries")
    return asked.select("query_id", inbox_name(F.col("query"), F.col("intent")).alias("name"))


def q_capture(spark, folder):
    """Search queries as if they were captured: refused titles, slugs free of those taken, filled bodies."""
    asked = table(spark, folder, "search_queries").select("query_id", F.col("query").alias("title"), F.lit(None).cast("string").alias("type"), F.when(F.col("query_id") % 2 == 0, F.col("query")).alias("content"))
    made = capture(asked, "query_id", "# {Title}\n\n{Content - what we know}\n", AS_OF[:10], titles_of(spark, folder))
    return made.select("query_id", "fault", "title", "note_type", "body", "status")


def q_slug(spark, folder):
    return notes_of(spark, folder).select("note_id", slug(F.col("description")).alias("slug"), title_of_path(F.concat(F.lit("inbox/"), F.col("title"), F.lit(".md"))).alias("name"))


def q_unique_slugs(spark, folder):
    return rules.unique_slugs(table(spark, folder, "search_queries"), "query_id", "query")


def q_validate(spark, folder):
    v = rules.validate(notes_of(spark, folder), "note_id", ["description", "type", "status", "created", "project"], {"type": rules.NOTE_TYPES, "status": rules.STATUSES}, 60)
    return v.select("note_id", "valid", F.array_join("errors", "; ").alias("errors"), F.array_join("warnings", "; ").alias("warnings"))


def q_placeholder(spark, folder):
    return notes_of(spark, folder).where(F.col("body").rlike(r"\{Content\s*[-—]")).select("note_id")


def q_status(spark, folder):
    notes, edges = notes_of(spark, folder), links_of(spark, folder)
    counts = notes.agg(F.count_if(F.col("space") == "notes").alias("n_notes"), F.count_if(F.col("space") == "inbox").alias("n_inbox"))
    return counts.crossJoin(g.orphans(notes, "title", edges).agg(F.count(F.lit(1)).alias("n_orphans")))


def q_health(spark, folder):
    """One row: notes, orphans, dangling targets, notes that break the schema, notes fading by the simple decay."""
    notes, edges = notes_of(spark, folder), cut_lineage(links_of(spark, folder))
    count = F.count(F.lit(1))
    broken = q_validate(spark, folder).where("not valid").agg(count.alias("n_violations"))
    dim = q_simple_decay(spark, folder).where("vitality < 0.2").agg(count.alias("n_fading"))
    parts = [g.orphans(notes, "title", edges).agg(count.alias("n_orphans")), g.dangling(notes, "title", edges).agg(count.alias("n_dangling")), broken, dim]
    out = notes.agg(count.alias("n_notes"))
    for part in parts:
        out = out.crossJoin(part)
    return out


def q_type_code(spark, folder):
    code = codes.type_code(F.col("type"))
    return notes_of(spark, folder).select("note_id", *[code[i].alias(t) for i, t in enumerate(codes.TYPES)])


def q_community_code(spark, folder):
    notes = notes_of(spark, folder)
    coded = notes.select("note_id", codes.community_code(F.col("note_id") % 17, F.lit(17)).alias("code"))
    return coded.select("note_id", *[F.round(F.col("code")[i], 6).alias(f"c{i}") for i in range(16)])


def q_piecewise(spark, folder):
    code = table(spark, folder, "events").select("event_id", (F.col("value") / 100.0).alias("v"), codes.piecewise(F.col("value") / 100.0).alias("code"))
    near = [F.round(codes.piecewise_cosine(F.col("v"), t), 6).alias(n) for t, n in ((1.0, "to_one"), (0.5, "to_half"), (0.8, "to_high"))]
    return code.select("event_id", *[F.round(F.col("code")[i], 6).alias(f"b{i}") for i in range(8)], *near)


def q_incremental(spark, folder):
    stored = table(spark, folder, "note_vectors").where("title is not null").select("title", "content_hash")
    return lifecycle.changed(notes_of(spark, folder), stored, "title", ["title", "description", "body"])


def q_upsert(spark, folder):
    old = table(spark, folder, "note_vectors").select("title", "content_hash", F.lit("old").alias("origin"))
    new = q_incremental(spark, folder).where("state = 'indexed'").select("title", "content_hash", F.lit("new").alias("origin"))
    return lifecycle.upsert(old, new, "title")


def q_index_status(spark, folder):
    return table(spark, folder, "note_vectors").agg(F.count(F.lit(1)).alias("n_rows"), F.count("content_hash").alias("n_hashed"), F.count("indexed_at").alias("n_dated"))


def q_frontmatter(spark, folder):
    parsed = parse_frontmatter(table(spark, folder, "documents"), "doc_id", "text")
    return parsed.select("doc_id", "has_frontmatter", F.get_json_object("fm_json", "$.type").alias("fm_type"), "fm_error", F.length("body").alias("body_chars"))


def q_frontmatter_round_trip(spark, folder):
    """Documents with frontmatter, written and parsed again: data and body must come back."""
    first = parse_frontmatter(table(spark, folder, "documents"), "doc_id", "text").where("has_frontmatter and fm_error is null")
    again = parse_frontmatter(write_frontmatter(first, "doc_id", "fm_json", "body"), "doc_id", "content")
    same = first.join(again.select("doc_id", F.col("fm_json").alias("fm2"), F.col("body").alias("body2")), "doc_id")
    return same.select("doc_id", F.col("fm_json").eqNullSafe(F.col("fm2")).alias("same_data"), (F.regexp_replace("body", "^\n", "") == F.col("body2")).alias("same_body"))


def q_mentions(spark, folder):
    return links.mentions(notes_of(spark, folder), "note_id", "body", titles_of(spark, folder))


def q_tag_overlap(spark, folder):
    """Notes that share tags with the stated query set, ids divisible by 100."""
    notes = notes_of(spark, folder)
    return links.overlap(notes.where("note_id % 100 = 0"), notes, "tags").select("title", "other", F.col("n").cast("bigint").alias("n"))


def q_project_overlap(spark, folder):
    notes = notes_of(spark, folder)
    return links.overlap(notes.where("note_id % 100 = 0"), notes, "project").select("title", "other", F.col("n").cast("bigint").alias("n"))


def q_triangles(spark, folder):
    edges = cut_lineage(links_of(spark, folder))
    return links.triangles(edges.select(F.col("src").alias("title"), F.col("dst").alias("via")).where("title <> via"), edges)


def q_suggest(spark, folder):
    """Suggestions for the stated query set, ids divisible by 100, against all notes."""
    notes, edges = notes_of(spark, folder), links_of(spark, folder)
    targets = notes.where("note_id % 100 = 0")
    found = links.mentions(targets.withColumnRenamed("title", "note"), "note", "body", titles_of(spark, folder))
    return links.suggest(targets, notes, edges, found).select("title", "other", "reason", F.round("confidence", 6).alias("confidence"))


def q_areas(spark, folder):
    return links.areas(notes_of(spark, folder).select("title", "project"), titles_of(spark, folder), {"graph": "architecture-map"}).select("title", F.array_join("areas", "|").alias("areas"))


def q_promote(spark, folder):
    """All inbox notes against all settled ones."""
    notes = notes_of(spark, folder)
    inbox = notes.where("space = 'inbox'")
    settled = notes.where("space = 'notes'")
    done = links.promote(inbox, settled, titles_of(spark, folder), links_of(spark, folder), KEYWORDS, {"graph": "architecture-map"}, AS_OF[:10])
    return done.select("title", "skipped", "note_type", F.array_join("project", "|").alias("project"), F.array_join("areas", "|").alias("areas"), F.size("links").alias("n_links"), "body", "status", "access_count")


QUERIES = {k: v for k, v in list(globals().items()) if k.startswith("q_")}

_CUTS = f"""{BOTH},
away(v, id) AS (SELECT dst, min(src) FROM both_ways GROUP BY dst UNION SELECT v, dst FROM away JOIN both_ways ON src = id WHERE dst <> v),
cuts AS MATERIALIZED (SELECT DISTINCT dst AS id FROM both_ways b WHERE NOT EXISTS (SELECT 1 FROM away WHERE v = b.dst AND id = b.src))"""
_BRIDGES = f"""{EDGES}, {IDS}, {INDEG}, {MEDIAN}, {HUBS}, {_CUTS},
why AS MATERIALIZED (SELECT id, 'articulation' AS reason FROM cuts UNION SELECT id, 'hub' FROM hubs UNION SELECT id, 'map' FROM ids WHERE id LIKE '% map' OR id = 'index'
  UNION SELECT id, 'connector' FROM indeg JOIN notes ON title = id WHERE len(project) >= 2 AND in_degree >= 3)"""
_DAYS = "abs(epoch_us(TIMESTAMP '{now}') - epoch_us({x})) / 86400e6::DOUBLE"
_CREATED = "try_strptime({x}, '%Y-%m-%d')"
_BOOSTS = f"""told AS (SELECT user_id, epoch_us(ts + INTERVAL {EVENT_MONTHS} MONTHS) AS t, sum(value / 5000.0::DOUBLE) AS b FROM events WHERE value >= 0 AND ts IS NOT NULL AND user_id IS NOT NULL GROUP BY ALL),
folded AS (SELECT user_id, list_reduce(list(struct_pack(v := least(1.0::DOUBLE, b), t := t, b := b) ORDER BY t), lambda a, x: struct_pack(v := least(1.0::DOUBLE, a.v * exp(-0.1::DOUBLE * (x.t - a.t) / 86400e6::DOUBLE) + x.b), t := x.t, b := x.b)) AS f FROM told GROUP BY user_id),
boosts AS MATERIALIZED (SELECT user_id, f.v * exp(-0.1::DOUBLE * abs(epoch_us(TIMESTAMP '{AS_OF}') - f.t) / 86400e6::DOUBLE) AS boost FROM folded)"""


def _lively_sql(boosted: bool) -> str:
    boost = "coalesce((SELECT boost FROM boosts WHERE user_id = note_id AND boost >= 0.001::DOUBLE), 0.0::DOUBLE)" if boosted else "0.0::DOUBLE"
    return f"""{_BRIDGES}, {_BOOSTS},
v0 AS (SELECT title, status, {boost} AS boost, coalesce(access_count, 0) AS n, CASE WHEN created IS NULL THEN 0.0::DOUBLE ELSE {_DAYS.format(now=AS_OF, x=_CREATED.format(x='created'))} END AS days FROM notes),
v1 AS (SELECT v0.*, coalesce((SELECT in_degree FROM indeg WHERE id = title), 0) AS in_degree, title IN (SELECT id FROM why) AS is_bridge FROM v0),
v2 AS (SELECT *, CASE WHEN n <= 0 THEN 0.5::DOUBLE WHEN days <= 0 THEN 1.0::DOUBLE ELSE 1 / (1 + exp(-(ln(n / 0.5::DOUBLE) - 0.5::DOUBLE * ln(days)))) END
  * (1.0::DOUBLE + 0.1::DOUBLE * least(in_degree, 10)) * (0.5::DOUBLE + 0.5::DOUBLE * (1.0::DOUBLE - exp(-n / 10.0::DOUBLE))) + boost AS v FROM v1),
v3 AS (SELECT title, status, in_degree, is_bridge, CASE WHEN v IS NULL THEN NULL ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, CASE WHEN is_bridge THEN greatest(v, 0.5::DOUBLE) ELSE v END)) END AS vitality FROM v2),
lively AS MATERIALIZED (SELECT *, CASE WHEN status = 'archived' THEN 'archived' WHEN vitality >= 0.6::DOUBLE THEN 'active' WHEN vitality >= 0.3::DOUBLE THEN 'stale' WHEN vitality >= 0.1::DOUBLE THEN 'fading' ELSE 'archived' END AS zone FROM v3)"""


_LIVELY = _lively_sql(True)
_ARCHIVE = f"""ar AS (SELECT title, coalesce(status, '') AS st, {_DAYS.format(now=AS_OF, x=_CREATED.format(x='coalesce(last_accessed, created)'))} AS days, coalesce((SELECT count(*) FROM edges WHERE dst = title), 0) AS d FROM notes),
archive AS (SELECT title FROM ar WHERE st <> 'archived' AND days IS NOT NULL AND ((days > 60 AND d < 2) OR (st IN ('completed', 'superseded') AND days > 30)))"""
_SIMPLE = f"SELECT title, round(greatest(0, least(1, exp(-({_DAYS.format(now=AS_OF, x=_CREATED.format(x='coalesce(last_accessed, created)'))}) / CASE type WHEN 'decision' THEN 90.0::DOUBLE WHEN 'idea' THEN 14.0::DOUBLE ELSE 30.0::DOUBLE END))), 6) AS vitality FROM notes WHERE {_CREATED.format(x='coalesce(last_accessed, created)')} IS NOT NULL"
_B = r"[\s\x{00a0}\x{1680}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"


def _count(text: str, patterns: list[str], flag: str) -> str:
    return " + ".join("coalesce(regexp_matches({}, '{}')::INT, 0)".format(text, (flag + p).replace("'", "''")) for p in patterns)


_INTENT = "WITH c AS (SELECT query_id, " + ", ".join(f"{_count('query', p, '(?i)')} AS {n}" for n, p in rules.INTENTS.items()) + " FROM search_queries), i AS (SELECT query_id, CASE WHEN greatest(" + ", ".join(rules.INTENTS) + ") = 0 THEN 'semantic' " + " ".join(f"WHEN {n} = greatest({', '.join(rules.INTENTS)}) THEN '{n}'" for n in rules.INTENTS) + " END AS intent, CASE WHEN greatest(" + ", ".join(rules.INTENTS) + ") >= 2 THEN 1.0::DOUBLE WHEN greatest(" + ", ".join(rules.INTENTS) + ") = 1 THEN 0.7::DOUBLE ELSE 0.5::DOUBLE END AS confidence FROM c)"


def _type_sql(given: str) -> str:
    text = "lower(concat_ws(chr(10), coalesce(title, ''), coalesce(body, '')))"
    counts = ", ".join(f"{_count('t', p, '')} AS k_{n}" for n, p in rules.TYPES.items())
    valid = "g IN (" + ", ".join(f"'{t}'" for t in rules.NOTE_TYPES) + ")"
    kind = f"CASE WHEN {valid} THEN g " + " ".join(f"WHEN k_{n} > 0 THEN '{n}'" for n in rules.TYPES) + " ELSE 'insight' END"
    level = f"CASE WHEN {valid} THEN 'high' " + " ".join(f"WHEN k_{n} > 1 THEN 'high' WHEN k_{n} > 0 THEN 'medium'" for n in rules.TYPES) + " ELSE 'low' END"
    return f"SELECT note_id, {kind} AS note_type, {level} AS type_confidence FROM (SELECT note_id, g, {counts} FROM (SELECT note_id, {given} AS g, {text} AS t FROM notes))"


_SLUG = "regexp_replace(trim(regexp_replace(lower({x}), '[^a-z0-9\\s-]', '', 'g')), '\\s+', '-', 'g')"
_PROJECTS = ", ".join("CASE WHEN " + " OR ".join(f"contains(t, '{w}')" for w in words) + f" THEN '{name}' END" for name, words in sorted(KEYWORDS.items()))
_V = {
    **{f: f"CASE WHEN {f} IS NULL OR regexp_replace({f}, '\\s+', '', 'g') = '' THEN 'Missing required field: {f}' END" for f in ("description", "type", "status", "created")},
    "project": "CASE WHEN project IS NULL OR len(project) = 0 THEN 'Missing required field: project' END",
}
_ENUM = {f: f"CASE WHEN {f} IS NOT NULL AND regexp_replace({f}, '\\s+', '', 'g') <> '' AND {f} NOT IN ({', '.join(repr(x) for x in v)}) THEN 'Invalid {f} value: ' || {f} END" for f, v in (("type", rules.NOTE_TYPES), ("status", rules.STATUSES))}
_VALIDATE = f"""SELECT note_id, errors = '' AS valid, errors, CASE WHEN trim(description) LIKE '%.' THEN 'Description should not end with a period' ELSE '' END AS warnings FROM (
SELECT note_id, description, concat_ws('; ', {', '.join(_V.values())}, {', '.join(_ENUM.values())}, CASE WHEN length(description) > 60 THEN 'Description exceeds max length (60)' END) AS errors FROM notes)"""
_FOLD = """SELECT user_id, round(f.v, 6) AS boost, strftime(make_timestamp(f.t), '%Y-%m-%d %H:%M:%S') AS updated FROM (
SELECT user_id, list_reduce(list(struct_pack(v := least(1.0::DOUBLE, b), t := t, b := b) ORDER BY t), lambda a, x: struct_pack(v := least(1.0::DOUBLE, a.v * exp(-0.1::DOUBLE * (x.t - a.t) / 86400e6::DOUBLE) + x.b), t := x.t, b := x.b)) AS f
FROM (SELECT user_id, epoch_us(ts) AS t, sum(value / 100.0::DOUBLE) AS b FROM events WHERE value >= 0 AND ts IS NOT NULL AND user_id IS NOT NULL GROUP BY ALL) GROUP BY user_id)"""


def _near(target: float) -> str:
    full, part = int(target * 8 + 1e-9), target * 8 - int(target * 8 + 1e-9)
    x = "least(1.0::DOUBLE, greatest(0.0::DOUBLE, value / 100.0::DOUBLE)) * 8"
    b, f = f"floor({x})", f"({x} - floor({x}))"
    size = (full + part * part) ** 0.5
    return f"CASE WHEN {b} + {f} * {f} > 0 THEN round((least({b}, {full}) + CASE WHEN {b} < {full} THEN {f} WHEN {b} = {full} THEN {f} * {part!r}::DOUBLE ELSE {part!r}::DOUBLE END) / (sqrt({b} + {f} * {f}) * {size!r}::DOUBLE), 6) ELSE 0.0 END"


_OVERLAP = "WITH x AS (SELECT DISTINCT note_id, title, unnest({c}) AS v FROM notes) SELECT a.title, b.title AS other, count(*) AS n FROM x a JOIN x b ON a.v = b.v WHERE a.note_id % 100 = 0 AND a.title <> b.title GROUP BY ALL"
_MENTIONS = f"""{TITLES}, low AS MATERIALIZED (SELECT note_id, title AS note, body, regexp_replace(lower(body), '{_B}', '-', 'g') AS b FROM notes WHERE body IS NOT NULL),
named AS (SELECT title, lower(title) AS t FROM titles WHERE regexp_matches(lower(title), '[a-z0-9_]')),
near AS MATERIALIZED (SELECT note_id, note, title, t, body, b FROM low JOIN named ON contains(b, regexp_replace(t, '{_B}', '-', 'g'))),
spots AS MATERIALIZED (SELECT note_id, note, title, body, length(t) AS n, unnest(list_filter(range(1, length(b) - length(t) + 2), lambda i: substr(b, i, length(t)) = regexp_replace(t, '{_B}', '-', 'g')
  AND NOT regexp_matches(substr(b, i - 1, CASE WHEN i > 1 THEN 1 ELSE 0 END), '[a-z0-9_]') AND NOT regexp_matches(substr(b, i + length(t), 1), '[a-z0-9_]'))) AS i FROM near),
said AS MATERIALIZED (SELECT note_id, note, title, i - 1 AS start, n AS length, instr(reverse(left(body, i - 1)), '[[') AS o, instr(reverse(left(body, i - 1)), ']]') AS c FROM spots s
  WHERE NOT EXISTS (SELECT 1 FROM spots l WHERE l.note_id = s.note_id AND (l.n > s.n OR (l.n = s.n AND l.title < s.title)) AND l.i < s.i + s.n AND s.i < l.i + l.n)),
mentioned AS MATERIALIZED (SELECT note_id, note, title, start, length, o > 0 AND (c = 0 OR o < c) AS linked FROM said)"""
_SHARED = "(SELECT a.title, b.title AS other, count(*) AS n FROM (SELECT DISTINCT note_id, title, unnest({c}) AS v FROM notes WHERE note_id % 100 = 0) a JOIN (SELECT DISTINCT title, unnest({c}) AS v FROM notes) b ON a.v = b.v WHERE a.title <> b.title GROUP BY ALL)"
_SUGGEST = f"""WITH {EDGES}, {_MENTIONS}, fresh AS MATERIALIZED (SELECT DISTINCT note AS title, title AS other FROM mentioned WHERE note_id % 100 = 0 AND NOT linked),
tri AS (SELECT l.title, e.src AS other, 0.5::DOUBLE AS c FROM fresh l JOIN edges e ON e.dst = l.other UNION ALL SELECT l.title, e.dst, 0.45::DOUBLE FROM fresh l JOIN edges e ON e.src = l.other),
offers AS (SELECT title, other, 1 AS o, 'title-match' AS reason, 0.9::DOUBLE AS c FROM fresh UNION ALL SELECT title, other, 2, 'project-overlap', 0.6::DOUBLE + n * 0.1::DOUBLE FROM {_SHARED.format(c='project')}
  UNION ALL SELECT title, other, 3, 'tag-overlap', 0.5::DOUBLE + n * 0.1::DOUBLE FROM {_SHARED.format(c='tags')} UNION ALL SELECT title, other, 4, 'shared-neighborhood', max(c) FROM tri GROUP BY ALL)
SELECT title, other, arg_min(reason, o) AS reason, round(arg_min(c, o), 6) AS confidence FROM offers WHERE title <> other GROUP BY ALL"""
_AREAS = f"""WITH {TITLES}, maps AS (SELECT title AS area, unnest(list_distinct(string_split_regex(lower(title), '[^a-z0-9]+'))) AS t FROM titles WHERE contains(lower(title), 'map')),
p AS (SELECT DISTINCT p FROM (SELECT unnest(project) AS p FROM notes) WHERE p IS NOT NULL),
hit AS (SELECT p, min(area) AS area FROM p JOIN maps ON t = string_split_regex(lower(p), '[^a-z0-9]+')[1] AND contains(lower(area), lower(p)) GROUP BY p),
per AS (SELECT title, unnest(CASE WHEN project IS NULL OR len(project) = 0 THEN [NULL] ELSE project END) AS p FROM notes)
SELECT title, string_agg(a, '|' ORDER BY a) AS areas FROM (SELECT DISTINCT per.title, coalesce(CASE WHEN per.p = 'graph' THEN 'architecture-map' END, hit.area, 'index') AS a FROM per LEFT JOIN hit USING (p)) GROUP BY title"""


def betweenness_sql(levels: int) -> str:
    """CTEs up to ``b`` (v, c): shortest paths of up to ``levels`` steps over ``edges``."""
    parts = ["e AS MATERIALIZED (SELECT * FROM edges WHERE src <> dst)", "u1 AS MATERIALIZED (SELECT src AS s, dst AS t, 1 AS d, 1.0::DOUBLE AS p FROM e)"]
    for i in range(1, levels):
        parts.append(f"u{i + 1} AS MATERIALIZED (SELECT * FROM u{i} UNION ALL SELECT a.s, e.dst, {i + 1}, sum(a.p) FROM u{i} a JOIN e ON a.t = e.src WHERE a.d = {i} AND a.s <> e.dst AND NOT EXISTS (SELECT 1 FROM u{i} x WHERE x.s = a.s AND x.t = e.dst) GROUP BY a.s, e.dst)")
    parts.append(f"b AS (SELECT x.t AS v, sum(x.p * y.p / z.p) AS c FROM u{levels} x JOIN u{levels} y ON x.t = y.s JOIN u{levels} z ON z.s = x.s AND z.t = y.t WHERE z.d = x.d + y.d GROUP BY x.t)")
    return ", ".join(parts)


_METRICS = f"""WITH RECURSIVE {_BRIDGES}, {pagerank_sql().removeprefix(IDS + ', ')}, {communities_sql().split(BOTH + ', ')[1]}, {betweenness_sql(12)}
SELECT i.id, in_degree, round(r, 6) AS pagerank, l8.c AS community, round(coalesce(b.c, 0) / (((SELECT count(*) FROM ids) - 1) * ((SELECT count(*) FROM ids) - 2)), 6) AS betweenness, i.id IN (SELECT id FROM why) AS is_bridge
FROM indeg i LEFT JOIN r20 ON r20.id = i.id LEFT JOIN l8 ON l8.id = i.id LEFT JOIN b ON b.v = i.id"""
ORACLES = {
    "q_mentions": f"WITH {_MENTIONS} SELECT note_id, title, start::INT AS start, length::INT AS length, linked FROM mentioned",
    "q_suggest": _SUGGEST,
    "q_areas": _AREAS,
    "q_node_metrics": _METRICS,
    "q_top_metrics": f"""WITH {EDGES}, {pagerank_sql()}, {betweenness_sql(12)}, m AS (SELECT 'pagerank' AS metric, id AS title, r AS score FROM r20 UNION ALL SELECT 'betweenness', id, coalesce(c, 0) / (((SELECT count(*) FROM ids) - 1) * ((SELECT count(*) FROM ids) - 2)) FROM ids LEFT JOIN b ON v = id)
SELECT metric, title, round(score, 6) AS score, row_number() OVER (PARTITION BY metric ORDER BY round(score, 9) DESC, title) AS rank FROM m QUALIFY rank <= 10""",
    "q_articulation": f"WITH RECURSIVE {EDGES}, {_CUTS} SELECT id FROM cuts",
    "q_bridges": f"WITH RECURSIVE {_BRIDGES} SELECT id, reason FROM why",
    "q_graph_summary": f"WITH RECURSIVE {_BRIDGES}, {communities_sql().split(BOTH + ', ')[1]} SELECT (SELECT count(*) FROM ids) AS n_nodes, (SELECT count(*) FROM edges) AS n_edges, (SELECT count(DISTINCT c) FROM l8) AS n_communities, (SELECT count(DISTINCT id) FROM why) AS n_bridges",
    "q_vitality": f"WITH RECURSIVE {_LIVELY} SELECT title, round(vitality, 6) AS vitality, in_degree, zone FROM lively",
    "q_zone_counts": f"WITH RECURSIVE {_LIVELY} SELECT z AS zone, (SELECT count(*) FROM lively WHERE zone = z) AS n FROM (SELECT unnest(['active', 'stale', 'fading', 'archived']) AS z)",
    "q_fading": f"WITH RECURSIVE {_LIVELY} SELECT title, round(vitality, 6) AS vitality FROM lively WHERE vitality < 0.3::DOUBLE",
    "q_by_vitality": f"WITH RECURSIVE {_LIVELY} SELECT title, round(vitality, 6) AS vitality FROM lively WHERE vitality IS NOT NULL ORDER BY round(vitality, 9) DESC, title LIMIT 10",
    "q_archive": f"WITH {EDGES}, {_ARCHIVE} SELECT title FROM archive",
    "q_archive_applied": f"WITH {EDGES}, {_ARCHIVE} SELECT CASE WHEN title IN (SELECT title FROM archive) THEN 'archived' ELSE status END AS status, count(*) AS n FROM notes GROUP BY 1",
    "q_prune": f"WITH RECURSIVE {_LIVELY} SELECT title, zone, in_degree, round(vitality, 6) AS vitality FROM lively WHERE coalesce(status, '') <> 'archived' AND zone IN ('fading', 'archived') AND NOT is_bridge AND in_degree < 2",
    "q_hotspots": f"""WITH RECURSIVE {_LIVELY}, {communities_sql().split(BOTH + ', ')[1]},
h AS (SELECT title, coalesce((SELECT c FROM l8 WHERE id = title), '-1') AS community, coalesce(vitality, 0.0) AS vitality FROM lively),
s AS (SELECT community, count(*) AS size, avg(vitality) AS m FROM h GROUP BY 1 ORDER BY round(m, 9) DESC, community LIMIT 5)
SELECT community, size, round(m, 6) AS mean_vitality, (SELECT string_agg(title, '|' ORDER BY rn) FROM (SELECT title, row_number() OVER (ORDER BY round(vitality, 9) DESC, title) AS rn FROM h WHERE h.community = s.community) WHERE rn <= 3) AS top_members FROM s""",
    "q_simple_decay": _SIMPLE,
    "q_revival": "SELECT title, round(CASE WHEN d IS NULL OR d < 0 OR d >= 14 THEN 0.0 ELSE exp(-0.2::DOUBLE * d) END, 6) AS revival, round(1 - exp(-n / 10.0::DOUBLE), 6) AS saturation FROM (SELECT title, abs(epoch_us(removed_at) - epoch_us(added_at)) / 86400e6::DOUBLE AS d, coalesce(access_count, 0) AS n FROM notes)",
    "q_boost_fold": _FOLD,
    "q_boost_decay": "SELECT user_id, round(sum(b), 6) AS boost FROM (SELECT user_id, value / 100.0::DOUBLE * exp(-0.1::DOUBLE * abs(epoch_us(TIMESTAMP '2024-02-01 00:00:00') - epoch_us(ts)) / 86400e6::DOUBLE) AS b FROM events) WHERE b >= 0.001::DOUBLE GROUP BY user_id",
    "q_intent": _INTENT + " SELECT query_id, intent, confidence FROM i",
    "q_weights": _INTENT + " SELECT DISTINCT i.intent, text, temporal, vitality, importance, type, community, split_title, split_description, split_body FROM i JOIN (VALUES "
    + ", ".join(f"('{k}', {', '.join(f'{x}::DOUBLE' for x in (*v, *rules.SPLIT_WEIGHTS[k]))})" for k, v in rules.SPACE_WEIGHTS.items())
    + ") w(intent, text, temporal, vitality, importance, type, community, split_title, split_description, split_body) ON i.intent = w.intent",
    "q_entities": f"WITH {TITLES}, t AS (SELECT title FROM titles UNION SELECT term FROM term_freqs) SELECT DISTINCT query_id, title FROM (SELECT DISTINCT query_id, lower(query) AS q FROM search_queries WHERE length(query) >= 3) JOIN (SELECT title, lower(title) AS lt FROM t WHERE length(title) >= 3) ON contains(q, lt)",
    "q_type": _type_sql("type"),
    "q_type_untyped": _type_sql("NULL::VARCHAR"),
    "q_projects": f"SELECT note_id, concat_ws(',', {_PROJECTS}) AS projects FROM (SELECT note_id, lower(concat_ws(chr(10), title, body)) AS t FROM notes)",
    "q_title_fault": "SELECT query_id, CASE WHEN t = '' THEN 'empty' WHEN regexp_matches(t, '(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$') THEN 'uuid' WHEN NOT contains(t, ' ') THEN 'one word' WHEN length(t) < 10 THEN 'short' END AS fault FROM (SELECT query_id, regexp_replace(coalesce(query, ''), '^" + _B + "+|" + _B + "+$', '', 'g') AS t FROM search_queries)",
    "q_inbox_name": f"SELECT query_id, CASE WHEN length(intent) > 0 THEN intent || '-' ELSE '' END || {_SLUG.format(x='query')} || '.md' AS name FROM search_queries",
    "q_capture": f"""WITH {TITLES}, c AS (SELECT query_id, query, regexp_replace(coalesce(query, ''), '^{_B}+|{_B}+$', '', 'g') AS t, {_SLUG.format(x='query')} AS s FROM search_queries),
f AS (SELECT *, CASE WHEN t = '' THEN 'empty' WHEN regexp_matches(t, '(?i)^[0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}}$') THEN 'uuid' WHEN NOT contains(t, ' ') THEN 'one word' WHEN length(t) < 10 THEN 'short' END AS fault FROM c),
g AS (SELECT query_id, CASE WHEN s = '' THEN 'note-' || query_id ELSE s END AS s, query FROM f WHERE fault IS NULL), r AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY query_id) AS rn FROM g)
SELECT query_id, NULL AS fault, list_filter(list_transform(range(1, rn + 50), lambda i: CASE WHEN i = 1 THEN s ELSE s || '-' || i END), lambda x: NOT list_contains(l, x))[rn] AS title, 'insight' AS note_type,
'# ' || query || chr(10) || chr(10) || CASE WHEN query_id % 2 = 0 THEN query ELSE '{{Content - what we know}}' END || chr(10) AS body, 'inbox' AS status FROM r, (SELECT list(title) AS l FROM titles)
UNION ALL SELECT query_id, fault, NULL, NULL, NULL, NULL FROM f WHERE fault IS NOT NULL""",
    "q_slug": f"SELECT note_id, {_SLUG.format(x='description')} AS slug, replace(title, '-', ' ') AS name FROM notes",
    "q_unique_slugs": f"SELECT query_id, CASE WHEN rn > 1 THEN s || '-' || rn ELSE s END AS slug FROM (SELECT query_id, s, row_number() OVER (PARTITION BY s ORDER BY query_id) AS rn FROM (SELECT query_id, CASE WHEN length({_SLUG.format(x='query')}) > 0 THEN {_SLUG.format(x='query')} ELSE 'note-' || query_id END AS s FROM search_queries))",
    "q_validate": _VALIDATE,
    "q_placeholder": "SELECT note_id FROM notes WHERE regexp_matches(body, '\\{Content\\s*[-—]')",
    "q_status": f"WITH {EDGES} SELECT count(*) FILTER (space = 'notes') AS n_notes, count(*) FILTER (space = 'inbox') AS n_inbox, count(*) FILTER (title NOT IN (SELECT dst FROM edges)) AS n_orphans FROM notes",
    "q_health": f"WITH {EDGES} SELECT (SELECT count(*) FROM notes) AS n_notes, (SELECT count(*) FROM notes WHERE title NOT IN (SELECT dst FROM edges)) AS n_orphans, (SELECT count(DISTINCT dst) FROM edges WHERE dst NOT IN (SELECT title FROM notes)) AS n_dangling, (SELECT count(*) FROM ({_VALIDATE}) WHERE NOT valid) AS n_violations, (SELECT count(*) FROM ({_SIMPLE}) WHERE vitality < 0.2::DOUBLE) AS n_fading",
    "q_type_code": "SELECT note_id, " + ", ".join(f"coalesce((type = '{t}')::INT, 0)::DOUBLE AS {t}" for t in codes.TYPES) + " FROM notes",
    "q_community_code": "SELECT note_id, " + ", ".join(f"round({'sin' if i % 2 == 0 else 'cos'}((note_id % 17) * {p}.0::DOUBLE / 17), 6) AS c{i}" for i, p in enumerate(codes.PRIMES)) + " FROM notes",
    "q_piecewise": "SELECT event_id, " + ", ".join(f"round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, least(1.0::DOUBLE, greatest(0.0::DOUBLE, value / 100.0::DOUBLE)) * 8 - {i})), 6) AS b{i}" for i in range(8)) + f", {_near(1.0)} AS to_one, {_near(0.5)} AS to_half, {_near(0.8)} AS to_high FROM events",
    "q_incremental": "SELECT n.title, h AS content_hash, CASE WHEN h IS NOT DISTINCT FROM v.content_hash THEN 'skipped' ELSE 'indexed' END AS state FROM (SELECT title, sha256(coalesce(title, '') || chr(10) || coalesce(description, '') || chr(10) || coalesce(body, '')) AS h FROM notes) n LEFT JOIN (SELECT title, content_hash FROM note_vectors WHERE title IS NOT NULL) v ON n.title = v.title",
    "q_index_status": "SELECT count(*) AS n_rows, count(content_hash) AS n_hashed, count(indexed_at) AS n_dated FROM note_vectors",
    "q_tag_overlap": _OVERLAP.format(c="tags"),
    "q_project_overlap": _OVERLAP.format(c="project"),
    "q_triangles": f"WITH {EDGES}, l AS (SELECT src AS title, dst AS via FROM edges WHERE src <> dst), t AS (SELECT l.title, e.src AS other, 0.5::DOUBLE AS c FROM l JOIN edges e ON e.dst = l.via UNION ALL SELECT l.title, e.dst, 0.45::DOUBLE FROM l JOIN edges e ON e.src = l.via) SELECT title, other, max(c) AS confidence FROM t WHERE title <> other AND NOT EXISTS (SELECT 1 FROM l WHERE l.title = t.title AND l.via = t.other) GROUP BY ALL",
}
ORACLES["q_upsert"] = "WITH i AS (" + ORACLES["q_incremental"] + ") SELECT title, content_hash, 'old' AS origin FROM note_vectors v WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.state = 'indexed' AND i.title = v.title) UNION ALL SELECT title, content_hash, 'new' FROM i WHERE state = 'indexed'"
