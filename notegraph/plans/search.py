"""Queries on text search, vectors, fusion, exposure and ranked retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from notegraph.operators import fusion
from notegraph.operators import graph as g
from notegraph.operators import retrieval
from notegraph.operators.rules import SPACE_WEIGHTS, SPLIT_WEIGHTS, classify_intent, entities
from notegraph.operators.text_index import bm25, bm25_top, corpus_stats, doc_lengths, document_frequency, postings, top_k
from notegraph.plans.graph import TITLES, links_of, notes_of, pagerank_sql, ppr_sql, titles_of
from notegraph.plans.notes import _lively_sql, lively_of, now
from notegraph.session import cut_lineage
from notegraph.sources.vault import AS_OF, access_events, table

#: The literal query of the smallest search.
QUERY = "what did we decide about the retry limit of the cold shard"


def q_postings(spark, folder):
    return postings(notes_of(spark, folder), "title")


def q_doc_lengths(spark, folder):
    return doc_lengths(notes_of(spark, folder), "title")


def q_corpus_stats(spark, folder):
    s = corpus_stats(doc_lengths(notes_of(spark, folder), "title"))
    return s.select("n_docs", F.round("avgdl", 6).alias("avgdl"))


def q_document_frequency(spark, folder):
    return document_frequency(postings(notes_of(spark, folder), "title"))


def q_bm25(spark, folder):
    """Top 10 documents for one literal query."""
    asked = spark.createDataFrame([(1, QUERY)], "query_id bigint, query string")
    found = bm25(asked, "query_id", "query", table(spark, folder, "documents"), "doc_id", {"text": 1.0})
    return top_k(found, "query_id", "doc_id", 10).select("doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


def q_bm25_batch(spark, folder):
    """Top 10 notes for every search query."""
    found = bm25_top(table(spark, folder, "search_queries"), "query_id", "query", notes_of(spark, folder), "title")
    return found.select("query_id", "title", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


def _signals(spark, folder):
    scored = table(spark, folder, "scored_notes")
    out = {}
    for name in ("composite", "keyword", "graph"):
        real = F.max(F.when(~F.isnan(name), F.col(name)))
        out[name] = scored.groupBy("query_id", "title").agg(real.alias("score")).where("score is not null")
    return out


def q_rrf(spark, folder):
    return fusion.fuse(_signals(spark, folder)).select("query_id", "title", F.round("score", 6).alias("score"), *[F.round(c, 6).alias(c) for c in ("composite", "keyword", "graph")])


def q_rrf_simple(spark, folder):
    return fusion.fuse(_signals(spark, folder), None).select("query_id", "title", F.round("score", 6).alias("score"))


def _top_fused(spark, folder):
    return top_k(fusion.fuse(_signals(spark, folder)), "query_id", "title", 10).select("query_id", "title", "score", "rank")


def q_exploration(spark, folder):
    out = fusion.explore(cut_lineage(_top_fused(spark, folder)), titles_of(spark, folder))
    return out.select("query_id", "title", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"), "was_exploration")


def q_propensity(spark, folder):
    log = table(spark, folder, "scored_notes").select(F.col("query_id").alias("event"), "title")
    return fusion.propensity(log, titles_of(spark, folder)).select("title", F.round("propensity", 6).alias("propensity"))


def q_propensity_distinct(spark, folder):
    log = table(spark, folder, "scored_notes").select(F.col("query_id").alias("event"), "title")
    return fusion.propensity(log, titles_of(spark, folder), distinct=True).select("title", F.round("propensity", 6).alias("propensity"))


def q_access_log(spark, folder):
    """Access events as they would be logged, unfolded again to check them."""
    scored = table(spark, folder, "scored_notes").select("query_id", "title", "score", "was_exploration").distinct()
    ranked = top_k(scored, "query_id", "title", 10)
    events = access_events(ranked, table(spark, folder, "search_queries"))
    return events.select("timestamp", F.explode("results").alias("r")).groupBy("timestamp").agg(F.count(F.lit(1)).alias("n"), F.min_by("r.title", "r.rank").alias("first"), F.count_if("r.wasExploration").alias("n_explored"))


def q_knn(spark, folder):
    """The five most similar embeddings of each whose id is divisible by 100."""
    rows = table(spark, folder, "embeddings")
    found = retrieval.nearest_of(rows.where("vec_id % 100 = 0"), rows, "vec_id", "embedding", 5, 64)
    return found.select(F.col("query").alias("vec_id"), "other", F.round("similarity", 5).alias("similarity"))


def q_near_titles(spark, folder):
    from notegraph.operators.links import near_titles

    rows = table(spark, folder, "note_vectors").where("not exists(title_vec, x -> isnan(x))")
    found = retrieval.nearest_of(rows.where("note_id % 100 = 0"), rows, "note_id", "title_vec", 10, 384)
    named = found.select(F.col("query").alias("title"), "other", "similarity")
    return near_titles(named).select("title", "other", F.round("confidence", 5).alias("confidence"))


def q_embed(spark, folder):
    """Hashed-token vectors of all notes' bodies: dimension and norm."""
    v = retrieval.embed(notes_of(spark, folder).select("note_id", "body"), "body", "vec")
    return v.select("note_id", F.size("vec").alias("dims"), F.round(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")), 4).alias("squared_norm"))


def body_links(notes):
    """``(title, links)``: distinct links of each body in their order there."""
    return notes.select("title", F.array_distinct(F.filter(F.transform(F.regexp_extract_all("body", F.lit(r"\[\[([^\]]+)\]\]"), 1), lambda x: F.trim(x)), lambda x: x != "")).alias("links"))


def q_enriched(spark, folder):
    notes = notes_of(spark, folder)
    return retrieval.enriched_text(notes, body_links(notes))


def queries_of(spark, folder, few=False):
    """All search queries; with ``few`` the stated set, those whose id is divisible by 100."""
    q = table(spark, folder, "search_queries").select("query_id", "query", "asked_at")
    return q.where("query_id % 100 = 0") if few else q


def asked_of(queries):
    """Queries with their intent by rule and their vector by the encoder."""
    return retrieval.embed(classify_intent(queries, "query").select("query_id", "query", "intent"), "query", "vec")


def facts_of(spark, folder, boosted):
    ranks = g.pagerank(cut_lineage(links_of(spark, folder))).select(F.col("id").alias("title"), F.col("rank").alias("pagerank"))
    lively = lively_of(spark, folder, boosted).select("title", "vitality")
    return notes_of(spark, folder).select("title", "type").join(lively, "title").join(ranks, "title", "left").withColumn("pagerank", F.coalesce("pagerank", F.lit(0.0)))


def _composite(spark, folder, asked, boosted, k=None):
    """The index is built by the encoder; community and time of indexing are those stored."""
    notes = notes_of(spark, folder)
    stored = table(spark, folder, "note_vectors").select("note_id", "community_vec", "indexed_at")
    kept = notes.select("title", "note_id").join(stored, "note_id", "left").drop("note_id")
    vectors = retrieval.index_vectors(notes, body_links(notes)).join(kept, "title")
    return retrieval.composite(asked, vectors, cut_lineage(facts_of(spark, folder, boosted)), now(), k)


def q_composite(spark, folder):
    """Every search query against every note."""
    asked = cut_lineage(asked_of(queries_of(spark, folder)))
    scored = _composite(spark, folder, asked, True)
    return scored.select("query_id", "title", *[F.round(c, 5).alias(c) for c in scored.columns[2:]])


def q_similar(spark, folder):
    """By vectors alone: no boosts in vitality, no exploration; archived notes dropped of the 50 candidates."""
    asked = cut_lineage(asked_of(queries_of(spark, folder, few=True)))
    found = top_k(_composite(spark, folder, asked, False, 50), "query_id", "title", 50, digits=7).drop("rank")
    live = found.join(notes_of(spark, folder).where("status = 'archived'").select("title"), "title", "left_anti")
    best = top_k(live, "query_id", "title", 10, digits=7)
    return best.select("query_id", "title", F.round("score", 5).alias("score"), F.col("rank").cast("bigint").alias("rank"))


def _ranked(spark, folder, few=False):
    """All signals follow from a query's text: each text is searched once, under the least id that has it."""
    copies = queries_of(spark, folder, few).withColumn("rep", F.min("query_id").over(W.partitionBy("query")))
    copies = cut_lineage(copies)
    asked = cut_lineage(asked_of(copies.where("query_id = rep").drop("rep")))
    edges = cut_lineage(links_of(spark, folder))
    titles = titles_of(spark, folder)
    seeds = cut_lineage(entities(asked, "query_id", "query", titles).withColumnRenamed("title", "id"))
    sets = seeds.groupBy("query_id").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    runs = cut_lineage(sets.select("query_id", F.min("query_id").over(W.partitionBy("ids")).alias("run")))
    first = seeds.join(runs.where("query_id = run").select("query_id"), "query_id", "left_semi").select("query_id", "id")
    ranks = g.personalized_pagerank(edges, first).withColumnRenamed("rank", "rank_score")
    graph = retrieval.graph_signal(asked, ranks, runs, 50)
    scores = _composite(spark, folder, asked, True, 50).select("query_id", "title", F.round("score", 7).alias("score"))
    return retrieval.ranked(asked, copies, notes_of(spark, folder), scores, graph, titles), copies, edges


def q_ranked(spark, folder):
    """Flagship: composite, BM25 and personalised PageRank from the entities, fused, archived notes dropped, a tenth explored."""
    return _ranked(spark, folder)[0].select("query_id", "title", F.round("score", 5).alias("score"), F.col("rank").cast("bigint").alias("rank"), "was_exploration")


def q_search_boosts(spark, folder):
    """Boosts after the searches of the query set, folded in order of their times."""
    result, asked, edges = _ranked(spark, folder, few=True)
    given = retrieval.boosts_of(cut_lineage(result), edges).join(asked.select("query_id", "asked_at"), "query_id")
    folded = fusion.fold_boosts(given, "title", "asked_at", "boost")
    return folded.select("title", F.round("boost", 6).alias("boost"), F.date_format("updated", "yyyy-MM-dd HH:mm:ss").alias("updated"))


QUERIES = {k: v for k, v in list(globals().items()) if k.startswith("q_")}

_STOP = ", ".join(f"'{w}'" for w in "a an and are as at be by for from has he in is it its of on or that the to was were will with".split())


def _tok(x: str) -> str:
    return f"list_filter(string_split_regex(lower(coalesce({x}, '')), '[^a-z0-9]+'), lambda t: length(t) >= 2 AND t NOT IN ({_STOP}))"


_POST = "tok AS (" + " UNION ALL ".join(f"SELECT title, unnest({_tok(f)}) AS term, {w}::DOUBLE AS w FROM notes WHERE title IS NOT NULL" for f, w in (("title", 3.0), ("description", 2.0), ("body", 1.0))) + "), post AS MATERIALIZED (SELECT title, term, sum(w) AS tf FROM tok GROUP BY ALL), len AS MATERIALIZED (SELECT title, len(" + _tok("title") + ") * 3.0::DOUBLE + len(" + _tok("description") + ") * 2.0::DOUBLE + len(" + _tok("body") + ") * 1.0::DOUBLE AS dl FROM notes WHERE title IS NOT NULL)"
_DOCPOST = f"post AS MATERIALIZED (SELECT doc_id, term, count(*)::DOUBLE AS tf FROM (SELECT doc_id, unnest({_tok('text')}) AS term FROM documents) GROUP BY ALL), len AS MATERIALIZED (SELECT doc_id, len({_tok('text')})::DOUBLE AS dl FROM documents)"


def _bm25(key: str, asked: str) -> str:
    return f"""st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM len), dfr AS MATERIALIZED (SELECT term, count(*) AS df FROM post GROUP BY 1),
w AS MATERIALIZED (SELECT {key}, term, ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl)) AS x FROM post JOIN len USING ({key}) JOIN dfr USING (term), st),
a AS MATERIALIZED (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest({_tok('query')}) AS term FROM {asked}) GROUP BY ALL),
bm AS MATERIALIZED (SELECT query_id, {key}, sum(times * x) AS score FROM a JOIN w USING (term) GROUP BY ALL)"""


_SIG = "sig AS MATERIALIZED (SELECT query_id, title, max(CASE WHEN isnan(composite) THEN NULL ELSE composite END) AS composite, max(CASE WHEN isnan(keyword) THEN NULL ELSE keyword END) AS keyword, max(CASE WHEN isnan(graph) THEN NULL ELSE graph END) AS graph FROM scored_notes GROUP BY ALL)"


def _fuse(weighted: bool) -> str:
    parts = []
    for name, weight in fusion.SIGNAL_WEIGHTS.items():
        top = f"{weight}::DOUBLE * {name}" if weighted else "1.0::DOUBLE"
        parts.append(f"SELECT query_id, title, '{name}' AS s, {name} AS own, {top} / (60 + row_number() OVER (PARTITION BY query_id ORDER BY round({name}, 9) DESC, title)) AS part FROM sig WHERE {name} IS NOT NULL")
    own = ", ".join(f"max(CASE WHEN s = '{n}' THEN own END) AS {n}" for n in fusion.SIGNAL_WEIGHTS)
    return f"fused AS MATERIALIZED (SELECT query_id, title, sum(part) AS score, {own} FROM ({' UNION ALL '.join(parts)}) GROUP BY ALL)"


def _explore(best: str) -> str:
    """CTEs that replace the tail of ``best`` (query_id, title, score, rank); the result is ``explored``."""
    return f"""ring AS MATERIALIZED (SELECT title AS pick, row_number() OVER (ORDER BY md5(title || '0'), title) - 1 AS place FROM titles), total AS (SELECT count(*) AS total FROM titles),
sz AS MATERIALIZED (SELECT query_id, count(*) AS n, greatest(1, floor(count(*) * 0.1::DOUBLE)::BIGINT) AS gives FROM {best} GROUP BY 1),
tries AS (SELECT query_id, gives, unnest(range(0, least(n + gives, total))) AS step, ('0x' || substr(md5(query_id::VARCHAR || '0'), 1, 8))::BIGINT % total AS start, total FROM sz, total),
offers AS (SELECT t.query_id, pick, gives, row_number() OVER (PARTITION BY t.query_id ORDER BY step) AS i FROM tries t JOIN ring ON ring.place = (t.start + t.step) % t.total WHERE NOT EXISTS (SELECT 1 FROM {best} b WHERE b.query_id = t.query_id AND b.title = pick)),
picks AS MATERIALIZED (SELECT query_id, pick, i FROM offers WHERE i <= gives), kp AS MATERIALIZED (SELECT query_id, n - (SELECT count(*) FROM picks p WHERE p.query_id = sz.query_id) AS keep FROM sz),
explored AS (SELECT query_id, title, score, rank, false AS was_exploration FROM {best} JOIN kp USING (query_id) WHERE rank <= keep UNION ALL SELECT query_id, pick, 0.0, keep + i, true FROM picks JOIN kp USING (query_id))"""


def _pl(v: str, target: float) -> str:
    full, part = int(target * 8 + 1e-9), target * 8 - int(target * 8 + 1e-9)
    x = f"(least(1.0::DOUBLE, greatest(0.0::DOUBLE, {v})) * 8)"
    b, f = f"floor({x})", f"({x} - floor({x}))"
    return f"CASE WHEN {b} + {f} * {f} > 0 THEN (least({b}, {full}) + CASE WHEN {b} < {full} THEN {f} WHEN {b} = {full} THEN {f} * {part!r}::DOUBLE ELSE {part!r}::DOUBLE END) / (sqrt({b} + {f} * {f}) * {(full + part * part) ** 0.5!r}::DOUBLE) ELSE 0.0 END"


def _w(intent: str, table: dict, place: int) -> str:
    return f"CASE {intent} " + " ".join(f"WHEN '{k}' THEN {v[place]}::DOUBLE" for k, v in table.items()) + " END"


_LINKED = r"""found_links AS (SELECT title, trim(unnest(l)) AS x, generate_subscripts(l, 1) AS i FROM (SELECT title, regexp_extract_all(body, '\[\[([^\]]+)\]\]', 1) AS l FROM notes)),
first_links AS (SELECT title, x, min(i) AS i, row_number() OVER (PARTITION BY title ORDER BY min(i)) AS rn FROM found_links WHERE x <> '' GROUP BY title, x),
connected AS (SELECT title, 'Connected: ' || string_agg(x, ', ' ORDER BY i) AS c FROM first_links WHERE rn <= 10 GROUP BY title),
enriched AS MATERIALIZED (SELECT n.title, concat_ws(chr(10), nullif(concat_ws(' ', CASE WHEN length(type) > 0 THEN '[' || upper(type) || ']' END, CASE WHEN len(project) > 0 THEN '[' || array_to_string(list_filter(project, lambda p: p IS NOT NULL), ', ') || ']' END), ''),
  n.title, CASE WHEN length(trim(description)) > 0 THEN description END, c) AS text FROM notes n LEFT JOIN connected USING (title))"""


def _vectors_sql(texts: str) -> str:
    """CTE ``vecs`` of (id, f, d, v), unit length, from a query of (id, f, text)."""
    return f"""heard AS (SELECT id, f, ('0x' || substr(md5(t), 1, 8))::BIGINT AS h FROM (SELECT id, f, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]{{2,}}')) AS t FROM ({texts}))),
raw AS MATERIALIZED (SELECT id, f, h % 384 AS d, sum(CASE WHEN h >= 2147483648 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END) AS v FROM heard GROUP BY ALL),
vecs AS MATERIALIZED (SELECT id, f, d, v / sqrt(sum(v * v) OVER (PARTITION BY id, f)) AS v FROM raw WHERE v <> 0)"""


def _composite_sql(boosted: bool, few: bool) -> str:
    from notegraph.functions.codes import INTENT_TYPES, TYPES
    from notegraph.plans.notes import _INTENT

    intents = _INTENT.removeprefix("WITH ")
    ranks = pagerank_sql().removeprefix(pagerank_sql().split(", n AS")[0] + ", ")
    code = "[" + ", ".join(f"coalesce((type = '{t}')::INT, 0)::DOUBLE" for t in TYPES) + "]"
    want = "CASE intent " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE[]" for k, v in INTENT_TYPES.items()) + " END"
    texts = """SELECT 'q' || query_id AS id, 'query' AS f, query AS text FROM asked UNION ALL SELECT title, 'title', title FROM notes
UNION ALL SELECT title, 'description', CASE WHEN length(description) > 0 THEN description ELSE title END FROM notes UNION ALL SELECT title, 'body', text FROM enriched"""
    return f"""WITH RECURSIVE {_lively_sql(boosted)}, {ranks}, {TITLES}, {intents}, {_LINKED},
asked AS MATERIALIZED (SELECT q.query_id, q.query, q.asked_at, i.intent FROM search_queries q JOIN i USING (query_id){" WHERE q.query_id % 100 = 0" if few else ""}),
{_vectors_sql(texts)},
cosines AS MATERIALIZED (SELECT a.query_id, n.f, n.id AS title, sum(q.v * n.v) AS s FROM asked a JOIN vecs q ON q.id = 'q' || a.query_id AND q.f = 'query' JOIN vecs n ON n.d = q.d AND n.f <> 'query' GROUP BY ALL),
fact AS MATERIALIZED (SELECT n.title, n.note_id, n.type, l.vitality, coalesce(r, 0.0) AS pr FROM notes n JOIN lively l ON l.title = n.title LEFT JOIN r20 ON r20.id = n.title),
top AS (SELECT CASE WHEN max(pr) > 0 THEN max(pr) ELSE 1.0 END AS top FROM fact),
met AS MATERIALIZED (SELECT a.query_id, a.intent, fact.*, community_vec, indexed_at, coalesce(x.s, 0.0::DOUBLE) AS c_title, coalesce(y.s, 0.0::DOUBLE) AS c_description, coalesce(z.s, 0.0::DOUBLE) AS c_body FROM asked a CROSS JOIN fact LEFT JOIN note_vectors USING (note_id)
  LEFT JOIN cosines x ON x.query_id = a.query_id AND x.title = fact.title AND x.f = 'title' LEFT JOIN cosines y ON y.query_id = a.query_id AND y.title = fact.title AND y.f = 'description' LEFT JOIN cosines z ON z.query_id = a.query_id AND z.title = fact.title AND z.f = 'body'),
sp AS MATERIALIZED (SELECT query_id, title, intent,
  {_w('intent', SPLIT_WEIGHTS, 0)} * c_title + {_w('intent', SPLIT_WEIGHTS, 1)} * c_description + {_w('intent', SPLIT_WEIGHTS, 2)} * c_body AS s_text,
  coalesce({_pl("exp(-greatest(0.0::DOUBLE, (epoch_us(TIMESTAMP '" + AS_OF + "') - epoch_us(indexed_at)) / 86400e6::DOUBLE) / 30.0::DOUBLE)", 1.0)} * CASE WHEN indexed_at IS NULL THEN NULL ELSE 1.0 END, 0.0) AS s_temporal,
  {_pl('coalesce(vitality, 0.5)', 1.0)} AS s_vitality,
  CASE WHEN intent IN ('procedural', 'decision') THEN {_pl('pr / top', 0.8)} ELSE {_pl('pr / top', 0.5)} END AS s_importance,
  CASE WHEN list_sum({code}) > 0 THEN list_cosine_similarity({want}, {code}) ELSE 0.0 END AS s_type,
  CASE WHEN coalesce(list_sum(list_transform(community_vec, lambda x: x::DOUBLE * x)), 0) > 0 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS s_community FROM met, top),
comp AS MATERIALIZED (SELECT query_id, title, {' + '.join(f"{_w('intent', SPACE_WEIGHTS, p)} * s_{s}" for p, s in enumerate(('text', 'temporal', 'vitality', 'importance', 'type', 'community')))} AS score, s_text, s_temporal, s_vitality, s_importance, s_type, s_community FROM sp)"""


_COMPOSITE = _composite_sql(True, False)
_ENTITIES = "SELECT query_id, title AS id FROM asked JOIN titles ON length(title) >= 3 AND length(query) >= 3 AND contains(lower(query), lower(title))"
_RANKED, _RANKED_FEW = (f"""{scored}, {ppr_sql(_ENTITIES)}, {_POST}, {_bm25('title', 'asked')},
own AS MATERIALIZED (SELECT query_id, id AS title, r AS score FROM p20 WHERE query_id IS NOT NULL),
walked AS MATERIALIZED (SELECT * FROM own UNION ALL SELECT a.query_id, p.id, p.r FROM asked a CROSS JOIN p20 p WHERE p.query_id IS NULL AND a.query_id NOT IN (SELECT query_id FROM own)),
cand AS MATERIALIZED (SELECT query_id, title, round(score, 7) AS score, 'composite' AS s, 2.0::DOUBLE AS wt FROM comp UNION ALL SELECT query_id, title, score, 'keyword', 1.0::DOUBLE FROM bm UNION ALL SELECT query_id, title, score, 'graph', 1.5::DOUBLE FROM walked),
ord AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id, s ORDER BY round(score, 9) DESC, title) AS rn FROM cand),
fu AS MATERIALIZED (SELECT query_id, title, sum(wt * score / (60 + rn)) AS score FROM ord WHERE rn <= 50 GROUP BY ALL),
best AS MATERIALIZED (SELECT query_id, title, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, title) AS rank FROM fu WHERE title NOT IN (SELECT title FROM notes WHERE status = 'archived') QUALIFY rank <= 10),
{_explore('best')}""" for scored in (_COMPOSITE, _composite_sql(True, True)))
_AFTER = f"""{_RANKED_FEW}, lead AS (SELECT query_id, title AS start, score AS u FROM explored WHERE rank <= 3 AND score > 0),
hop1 AS (SELECT query_id, start, u, dst AS id FROM lead JOIN both_ways ON src = start WHERE u * 0.6::DOUBLE >= 0.01::DOUBLE),
hop2 AS (SELECT DISTINCT h.query_id, start, u, dst AS id FROM hop1 h JOIN both_ways ON src = id WHERE dst <> start AND u * 0.6::DOUBLE * 0.6::DOUBLE >= 0.01::DOUBLE AND NOT EXISTS (SELECT 1 FROM hop1 o WHERE o.query_id = h.query_id AND o.start = h.start AND o.id = dst)),
gains AS (SELECT query_id, id AS title, sum(b) AS b FROM (SELECT query_id, id, u * 0.6::DOUBLE AS b FROM hop1 UNION ALL SELECT query_id, id, u * 0.6::DOUBLE * 0.6::DOUBLE FROM hop2) GROUP BY ALL),
timed AS (SELECT title, epoch_us(asked_at) AS t, sum(b) AS b FROM gains JOIN asked USING (query_id) WHERE asked_at IS NOT NULL GROUP BY ALL)
SELECT title, round(f.v, 6) AS boost, strftime(make_timestamp(f.t), '%Y-%m-%d %H:%M:%S') AS updated FROM (
SELECT title, list_reduce(list(struct_pack(v := least(1.0::DOUBLE, b), t := t, b := b) ORDER BY t), lambda a, x: struct_pack(v := least(1.0::DOUBLE, a.v * exp(-0.1::DOUBLE * (x.t - a.t) / 86400e6::DOUBLE) + x.b), t := x.t, b := x.b)) AS f FROM timed GROUP BY title)"""
_PROP = "SELECT title, round(greatest(0.01::DOUBLE, coalesce((SELECT {c} FROM scored_notes s WHERE s.title = t.title), 0) / (SELECT count(DISTINCT query_id) FROM scored_notes)), 6) AS propensity FROM titles t"

ORACLES = {
    "q_postings": f"WITH {_POST} SELECT title, term, tf FROM post",
    "q_doc_lengths": f"WITH {_POST} SELECT title, dl FROM len",
    "q_corpus_stats": f"WITH {_POST} SELECT count(*) AS n_docs, round(avg(dl), 6) AS avgdl FROM len",
    "q_document_frequency": f"WITH {_POST} SELECT term, count(*) AS df FROM post GROUP BY term",
    "q_bm25": f"WITH lit AS (SELECT 1 AS query_id, '{QUERY}' AS query), {_DOCPOST}, {_bm25('doc_id', 'lit')} SELECT doc_id, round(score, 6) AS score, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS rank FROM bm QUALIFY rank <= 10",
    "q_bm25_batch": f"WITH {_POST}, {_bm25('title', 'search_queries')} SELECT query_id, title, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, title) AS rank FROM bm QUALIFY rank <= 10",
    "q_rrf": f"WITH {_SIG}, {_fuse(True)} SELECT query_id, title, round(score, 6) AS score, round(composite, 6) AS composite, round(keyword, 6) AS keyword, round(graph, 6) AS graph FROM fused",
    "q_rrf_simple": f"WITH {_SIG}, {_fuse(False)} SELECT query_id, title, round(score, 6) AS score FROM fused",
    "q_exploration": f"WITH {TITLES}, {_SIG}, {_fuse(True)}, best AS MATERIALIZED (SELECT query_id, title, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, title) AS rank FROM fused QUALIFY rank <= 10), {_explore('best')} SELECT query_id, title, round(score, 6) AS score, rank, was_exploration FROM explored",
    "q_propensity": f"WITH {TITLES} " + _PROP.format(c="count(*)"),
    "q_propensity_distinct": f"WITH {TITLES} " + _PROP.format(c="count(DISTINCT query_id)"),
    "q_knn": "SELECT vec_id, other, round(s, 5) AS similarity FROM (SELECT a.vec_id, b.vec_id AS other, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(s, 9) DESC, b.vec_id) AS rn FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0) WHERE rn <= 5",
    "q_composite": f"{_COMPOSITE} SELECT query_id, title, round(score, 5) AS score, round(s_text, 5) AS s_text, round(s_temporal, 5) AS s_temporal, round(s_vitality, 5) AS s_vitality, round(s_importance, 5) AS s_importance, round(s_type, 5) AS s_type, round(s_community, 5) AS s_community FROM comp",
    "q_similar": f"{_composite_sql(False, True)}, held AS (SELECT query_id, title, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 7) DESC, title) AS rn FROM comp) SELECT query_id, title, round(score, 5) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 7) DESC, title) AS rank FROM held WHERE rn <= 50 AND title NOT IN (SELECT title FROM notes WHERE status = 'archived') QUALIFY rank <= 10",
    "q_search_boosts": _AFTER,
    "q_embed": f"WITH {_vectors_sql("SELECT note_id AS id, 'body' AS f, body AS text FROM notes")} SELECT n.note_id, CASE WHEN count(id) > 0 THEN 384 END AS dims, CASE WHEN count(id) > 0 THEN 1.0::DOUBLE END AS squared_norm FROM notes n LEFT JOIN vecs ON id = note_id GROUP BY n.note_id",
    "q_enriched": f"WITH {_LINKED} SELECT title, text FROM enriched",
    "q_near_titles": "WITH v AS (SELECT note_id, title_vec::DOUBLE[] AS x FROM note_vectors WHERE len(title_vec) = 384 AND len(list_filter(title_vec, lambda y: isnan(y))) = 0 AND list_sum(list_transform(title_vec, lambda y: abs(y))) > 0) SELECT title, other, round(least(0.95::DOUBLE, s), 5) AS confidence FROM (SELECT a.note_id AS title, b.note_id AS other, list_cosine_similarity(a.x, b.x) AS s, row_number() OVER (PARTITION BY a.note_id ORDER BY round(s, 9) DESC, b.note_id) AS rn FROM v a JOIN v b ON a.note_id <> b.note_id WHERE a.note_id % 100 = 0) WHERE rn <= 5 AND s > 0.5::DOUBLE",
    "q_access_log": "WITH s AS (SELECT DISTINCT query_id, title, score, was_exploration FROM scored_notes), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC NULLS LAST, title) AS rank FROM s QUALIFY rank <= 10) SELECT strftime(asked_at, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS timestamp, count(*) AS n, min_by(title, rank) AS first, count(*) FILTER (was_exploration) AS n_explored FROM r JOIN search_queries USING (query_id) GROUP BY 1",
    "q_ranked": f"{_RANKED} SELECT query_id, title, round(score, 5) AS score, rank, was_exploration FROM explored",
}
