"""The training-data queries: each takes (spark, folder) and reads whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notegraph.llm.distinctiveness import most_characteristic, residual_idf
from notegraph.llm.markup import clean_markup
from notegraph.llm.packing import fill_report, pack
from notegraph.llm.rank_fusion import fused_top, reciprocal_rank_fusion
from notegraph.llm.residue import find_residue
from notegraph.llm.text_quality import STATISTICS, classify_documents, document_statistics
from notegraph.llm.tokenizer import count_tokens, encode_corpus
from notegraph.llm.truncation import score_truncation, truncation_rates
from notegraph.llm.vector_search import exact_neighbours, nearest, neighbour_pairs
from notegraph.operators.skew import hot_keys
from notegraph.session import cut_lineage

SIGNALS = ["composite", "keyword", "graph", "rrf"]
VECTORS = ["title_vec", "desc_vec", "body_vec"]


def _read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def p1_ranking(spark: SparkSession, folder: str) -> DataFrame:
    """Every candidate with any signal: fused score, number of signals, rank in its query."""
    from pyspark.sql import Window as W

    fused = reciprocal_rank_fusion(_read(spark, folder, "scored_notes"), "query_id", "title", SIGNALS)
    return fused.select("query_id", "title", F.round("fused", 9).alias("fused"), "n_signals").withColumn("rank", F.rank().over(W.partitionBy("query_id").orderBy(F.desc("fused"))))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    scores = _read(spark, folder, "scored_notes")
    hot = hot_keys(scores, "query_id")
    fused = reciprocal_rank_fusion(scores, "query_id", "title", SIGNALS, hot=hot)
    return fused_top(fused, _read(spark, folder, "search_queries"), "query_id", "title", "top_n", hot).select("query_id", "title")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return find_residue(_read(spark, folder, "notes"), "note_id", "body", "space").where("residue is not null").select("note_id").distinct()


def p2_clean(spark: SparkSession, folder: str) -> DataFrame:
    """The notes without residue: the table, less the affected rows."""
    notes = _read(spark, folder, "notes")
    return notes.join(p2_found(spark, folder), "note_id", "left_anti").select("note_id", "title", "space", "body")


def p3_scores(spark: SparkSession, folder: str) -> DataFrame:
    scored = residual_idf(_read(spark, folder, "term_freqs"), "term", "title", "tf")
    return scored.select("term", "title", "tf", "df", (F.round("ridf", 6) + 0.0).alias("ridf"), (F.round("score", 6) + 0.0).alias("score"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return most_characteristic(residual_idf(_read(spark, folder, "term_freqs"), "term", "title", "tf"), "term", "title").select("title", "term")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return neighbour_pairs(nearest(_read(spark, folder, "note_vectors"), "note_id", VECTORS))


def p4_recall(spark: SparkSession, folder: str) -> DataFrame:
    """Recall of the search against brute force, per field, for the notes whose id is divisible by 100."""
    vectors = _read(spark, folder, "note_vectors")
    found = nearest(vectors, "note_id", VECTORS).where(F.col("id") % 100 == 0).withColumn("hit", F.lit(1))
    exact = None
    for name in VECTORS:
        one = exact_neighbours(vectors, "note_id", name)
        exact = one if exact is None else exact.unionByName(one)
    joined = exact.join(found.select("vec_field", "id", "neighbour", "hit"), ["vec_field", "id", "neighbour"], "left")
    return joined.groupBy("vec_field").agg(F.count(F.lit(1)).alias("n_true"), (F.count("hit") / F.count(F.lit(1))).alias("recall"))


def p5_clean(spark: SparkSession, folder: str) -> DataFrame:
    return clean_markup(_read(spark, folder, "notes"), "note_id", "body").select("note_id", "text", "kinds", "n_nodes", "n_dropped")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return p5_clean(spark, folder).select("note_id", F.explode("kinds").alias("kind")).distinct()


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return score_truncation(_read(spark, folder, "enhancements"), "suggestion_id", "description", "provider").where("is_cut").select("suggestion_id")


def p7_rates(spark: SparkSession, folder: str) -> DataFrame:
    return truncation_rates(score_truncation(_read(spark, folder, "enhancements"), "suggestion_id", "description", "provider"), "suggestion_id", "provider")


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode_corpus(_read(spark, folder, "documents"), "doc_id", "text")


def p9_pack(spark: SparkSession, folder: str) -> DataFrame:
    sized = cut_lineage(count_tokens(_read(spark, folder, "documents"), "doc_id", "text"))
    return pack(sized, "doc_id", "n_tokens", _read(spark, folder, "pack_budgets"), "budget_id", "capacity")


def p9_fill(spark: SparkSession, folder: str) -> DataFrame:
    """Containers used and share of room left over, per budget."""
    return fill_report(p9_pack(spark, folder), _read(spark, folder, "pack_budgets"), "budget_id", "capacity")


def p10_stats(spark: SparkSession, folder: str) -> DataFrame:
    stats = document_statistics(_read(spark, folder, "documents"), "doc_id", "text")
    return stats.select("doc_id", *[F.round(s, 6).alias(s) for s in STATISTICS])


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return classify_documents(_read(spark, folder, "documents"), "doc_id", "text").where("kind <> 'prose'").select("doc_id", "kind")


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_ranking, p2_found, p2_clean, p3_found, p3_scores, p4_found, p4_recall, p5_found, p5_clean, p7_found, p7_rates, p8_ids, p9_pack, p9_fill, p10_found, p10_stats)
}

_FUSED = """
WITH c AS (
  SELECT query_id, title,
         max(CASE WHEN isnan(composite) THEN NULL ELSE composite END) AS composite, max(CASE WHEN isnan(keyword) THEN NULL ELSE keyword END) AS keyword,
         max(CASE WHEN isnan(graph) THEN NULL ELSE graph END) AS graph, max(CASE WHEN isnan(rrf) THEN NULL ELSE rrf END) AS rrf
  FROM scored_notes WHERE query_id IS NOT NULL AND title IS NOT NULL GROUP BY ALL),
r AS (
  SELECT *, rank() OVER (PARTITION BY query_id ORDER BY composite DESC NULLS LAST) AS r1, rank() OVER (PARTITION BY query_id ORDER BY keyword DESC NULLS LAST) AS r2,
         rank() OVER (PARTITION BY query_id ORDER BY graph DESC NULLS LAST) AS r3, rank() OVER (PARTITION BY query_id ORDER BY rrf DESC NULLS LAST) AS r4 FROM c),
f AS (
  SELECT query_id, title,
         CASE WHEN composite IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE / (60 + r1) END + CASE WHEN keyword IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE / (60 + r2) END
         + CASE WHEN graph IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE / (60 + r3) END + CASE WHEN rrf IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE / (60 + r4) END AS fused,
         ((composite IS NOT NULL)::INT + (keyword IS NOT NULL)::INT + (graph IS NOT NULL)::INT + (rrf IS NOT NULL)::INT) AS n_signals FROM r)
"""

_RIDF = """
WITH once AS (
  SELECT term, title, max(coalesce(CASE WHEN isnan(tf) THEN NULL ELSE tf END, 0.0)) AS tf FROM term_freqs WHERE term IS NOT NULL AND title IS NOT NULL GROUP BY ALL),
n AS (SELECT count(DISTINCT title)::DOUBLE AS n FROM once),
s AS (
  SELECT term, count(*) AS df, CASE WHEN sum(tf) > 0 THEN -log2(count(*) / any_value(n)) + log2(1 - exp(-sum(tf) / any_value(n))) ELSE 0.0 END AS ridf
  FROM once, n GROUP BY term),
p AS (SELECT term, title, tf, df, ridf, ridf * tf AS score FROM once JOIN s USING (term))
"""

ORACLES = {
    "p1_found": _FUSED + """
SELECT query_id, title FROM (
  SELECT f.query_id, f.title, q.top_n, row_number() OVER (PARTITION BY f.query_id ORDER BY round(fused, 12) DESC, f.title) AS rn
  FROM f JOIN (SELECT query_id, max(top_n) AS top_n FROM search_queries GROUP BY 1) q USING (query_id) WHERE n_signals > 0) WHERE rn <= top_n""",
    "p1_ranking": _FUSED + """
SELECT query_id, title, round(fused, 9) AS fused, n_signals, rank() OVER (PARTITION BY query_id ORDER BY round(fused, 9) DESC) AS rank FROM f WHERE n_signals > 0""",
    "p3_scores": _RIDF + "SELECT term, title, tf, df, round(ridf, 6) + 0.0 AS ridf, round(score, 6) + 0.0 AS score FROM p",
    "p3_found": _RIDF + """
SELECT title, term FROM (
  SELECT title, term, tf, count(*) OVER (PARTITION BY title) AS n,
         row_number() OVER (PARTITION BY title ORDER BY (tf >= 2) DESC, score DESC, df, tf DESC, term DESC) AS rn FROM p) WHERE n >= 40 AND rn = 1 AND tf >= 2""",
}
