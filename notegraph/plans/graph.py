"""Queries on the link graph of the notes and on the trade graph of nations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notegraph.operators import graph as g
from notegraph.operators.text_index import top_k
from notegraph.session import cut_lineage
from notegraph.sources.vault import table

ROUNDS = 20


def notes_of(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "notes")


def links_of(spark: SparkSession, folder: str) -> DataFrame:
    return g.link_scan(notes_of(spark, folder), "title", "body")


def titles_of(spark: SparkSession, folder: str) -> DataFrame:
    return notes_of(spark, folder).select("title").union(table(spark, folder, "map_notes").select("title")).where("title is not null").distinct()


def trade_of(spark: SparkSession, folder: str) -> DataFrame:
    """Nations between which large quantities were traded: customers' to suppliers'."""
    big = table(spark, folder, "lineitem").where("l_quantity >= 49").select("l_orderkey", "l_suppkey")
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"))
    buyers = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    sellers = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    return big.join(orders, "l_orderkey").join(buyers, "c_custkey").join(sellers, "l_suppkey").select(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst")).distinct()


def q_link_scan(spark, folder):
    return links_of(spark, folder)


def q_nodes(spark, folder):
    return g.nodes(links_of(spark, folder))


def q_undirected(spark, folder):
    return g.undirected(links_of(spark, folder))


def q_orphans(spark, folder):
    return g.orphans(titles_of(spark, folder), "title", links_of(spark, folder))


def q_dangling(spark, folder):
    return g.dangling(titles_of(spark, folder), "title", links_of(spark, folder))


def q_backlinks(spark, folder):
    return g.backlinks(links_of(spark, folder)).select("dst", F.array_join("sources", "|").alias("sources"))


def q_degrees(spark, folder):
    e = links_of(spark, folder)
    out = g.degree(e, "src").withColumnRenamed("degree", "out_degree")
    return g.in_degrees(e).join(out, "id", "left").select("id", F.col("in_degree").cast("bigint").alias("in_degree"), F.coalesce("out_degree", F.lit(0)).cast("bigint").alias("out_degree"))


def q_upper_median(spark, folder):
    return g.upper_median(g.in_degrees(trade_of(spark, folder)), "in_degree")


def q_hubs(spark, folder):
    return g.hubs(links_of(spark, folder)).select("id", F.col("in_degree").cast("bigint").alias("in_degree"))


def written_links(spark, folder):
    """Edges from what promotions name, as it is written there: notes, maps and others."""
    refs = table(spark, folder, "promote_overrides").select(F.col("title").alias("src"), F.explode("links").alias("dst"))
    return refs.select("src", F.trim("dst").alias("dst")).where("src is not null and dst <> ''").distinct()


def q_map_nodes(spark, folder):
    return g.map_nodes(written_links(spark, folder))


def q_connectors(spark, folder):
    return g.connectors(notes_of(spark, folder), links_of(spark, folder), 2)


def q_cross_project(spark, folder):
    return notes_of(spark, folder).where(F.size("project") >= 2).select("title", F.size("project").cast("bigint").alias("n_projects"))


def q_pagerank(spark, folder):
    return g.pagerank(links_of(spark, folder), rounds=ROUNDS).select("id", F.round("rank", 6).alias("rank"))


def q_pagerank_trade(spark, folder):
    return g.pagerank(trade_of(spark, folder), rounds=ROUNDS).select(F.col("id").cast("bigint").alias("id"), F.round("rank", 6).alias("rank"))


def q_important(spark, folder):
    ranks = g.pagerank(links_of(spark, folder), rounds=ROUNDS).withColumnRenamed("id", "title")
    known = titles_of(spark, folder).join(ranks, "title", "left").select("title", F.coalesce("rank", F.lit(0.0)).alias("score"))
    best = known.orderBy(F.round("score", 9).desc(), "title").limit(10)
    return best.select("title", F.round("score", 6).alias("score"))


def seeds_of(spark, folder):
    """The stated query set: notes whose id is divisible by 100, each its own seed."""
    return notes_of(spark, folder).where("note_id % 100 = 0").select(F.col("note_id").alias("query_id"), F.col("title").alias("id"))


def q_ppr(spark, folder):
    ranks = g.personalized_pagerank(links_of(spark, folder), seeds_of(spark, folder), rounds=ROUNDS)
    return ranks.select("query_id", "id", F.round("rank", 6).alias("rank"))


def q_activation(spark, folder):
    sources = notes_of(spark, folder).where("title is not null").select(F.col("title").alias("source"), (F.coalesce("access_count", F.lit(0)) / F.lit(32.0)).alias("utility"))
    return g.spread_activation(links_of(spark, folder), sources).select("source", "id", F.col("hop").cast("bigint").alias("hop"), F.round("boost", 6).alias("boost"))


def q_components(spark, folder):
    return g.components(links_of(spark, folder))


def q_articulation(spark, folder):
    return g.articulation_points(links_of(spark, folder))


def q_bridges(spark, folder):
    return g.bridges(notes_of(spark, folder), links_of(spark, folder))


def q_betweenness(spark, folder):
    return g.betweenness(trade_of(spark, folder)).select(F.col("id").cast("bigint").alias("id"), F.round("betweenness", 6).alias("betweenness"))


def q_communities(spark, folder):
    return g.communities(links_of(spark, folder))


def q_community_stats(spark, folder):
    labels = g.communities(links_of(spark, folder))
    return labels.groupBy("community").agg(F.count(F.lit(1)).alias("size"), F.array_join(F.sort_array(F.collect_list("id")), "|").alias("members"))


def q_graph_summary(spark, folder):
    e = cut_lineage(links_of(spark, folder))
    return g.graph_summary(e, g.communities(e), g.bridges(notes_of(spark, folder), e))


def q_node_metrics(spark, folder):
    """The wide table of all metrics: each computed once, joined on the node."""
    e = cut_lineage(links_of(spark, folder))
    marks = g.bridges(notes_of(spark, folder), e).groupBy("id").agg(F.lit(True).alias("is_bridge"))
    wide = g.in_degrees(e).join(g.pagerank(e, rounds=ROUNDS), "id", "left").join(g.communities(e), "id", "left").join(g.betweenness(e), "id", "left").join(marks, "id", "left")
    return wide.select("id", "in_degree", F.round("rank", 6).alias("pagerank"), "community", F.round("betweenness", 6).alias("betweenness"), F.coalesce("is_bridge", F.lit(False)).alias("is_bridge"))


def q_top_metrics(spark, folder):
    """The ten best nodes by PageRank and by betweenness."""
    e = cut_lineage(links_of(spark, folder))
    parts = [("pagerank", g.pagerank(e, rounds=ROUNDS), "rank"), ("betweenness", g.betweenness(e), "betweenness")]
    all_of = [df.select(F.lit(name).alias("metric"), F.col("id").alias("title"), F.col(value).alias("score")) for name, df, value in parts]
    best = top_k(all_of[0].unionByName(all_of[1]), "metric", "title", 10)
    return best.select("metric", "title", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


def q_top_hubs_trade(spark, folder):
    d = g.in_degrees(trade_of(spark, folder)).withColumn("all", F.lit(1))
    return top_k(d, "all", "id", 10, "in_degree", None).select(F.col("id").cast("bigint").alias("id"), F.col("in_degree").cast("bigint").alias("in_degree"), F.col("rank").cast("bigint").alias("rank"))


QUERIES = {k: v for k, v in list(globals().items()) if k.startswith("q_")}

EDGES = r"""edges AS MATERIALIZED (
  SELECT DISTINCT title AS src, trim(x) AS dst
  FROM (SELECT title, unnest(regexp_extract_all(body, '\[\[([^\]]+)\]\]', 1)) AS x FROM notes WHERE title IS NOT NULL) WHERE trim(x) <> '')"""
TITLES = "titles AS (SELECT title FROM notes WHERE title IS NOT NULL UNION SELECT title FROM map_notes WHERE title IS NOT NULL)"
TRADE = """edges AS MATERIALIZED (
  SELECT DISTINCT c_nationkey AS src, s_nationkey AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN supplier ON l_suppkey = s_suppkey WHERE l_quantity >= 49)"""
IDS = "ids AS MATERIALIZED (SELECT src AS id FROM edges UNION SELECT dst FROM edges)"
BOTH = "both_ways AS MATERIALIZED (SELECT src, dst FROM edges WHERE src <> dst UNION SELECT dst, src FROM edges WHERE src <> dst)"
INDEG = "indeg AS MATERIALIZED (SELECT id, count(src) AS in_degree FROM ids LEFT JOIN edges ON id = dst GROUP BY id)"
MEDIAN = "med AS (SELECT coalesce((SELECT in_degree FROM (SELECT in_degree, row_number() OVER (ORDER BY in_degree) AS rn FROM indeg) WHERE rn = (SELECT count(*) // 2 + 1 FROM indeg)), 0) AS upper_median)"
HUBS = "hubs AS (SELECT id, in_degree FROM indeg, med WHERE upper_median > 0 AND in_degree > 2 * upper_median)"


def pagerank_sql(rounds: int = ROUNDS) -> str:
    """CTEs ``r0`` .. ``r<rounds>``; the last is the result."""
    parts = [
        IDS, "n AS (SELECT count(*)::DOUBLE AS n FROM ids)", "outd AS MATERIALIZED (SELECT src, count(*) AS o FROM edges GROUP BY 1)",
        "every AS MATERIALIZED (SELECT id, o IS NULL AS sink FROM ids LEFT JOIN outd ON id = src)", "r0 AS MATERIALIZED (SELECT id, sink, 1.0::DOUBLE / n AS r FROM every, n)",
    ]
    for i in range(rounds):
        parts.append(
            f"r{i + 1} AS MATERIALIZED (SELECT e.id, e.sink, 0.15::DOUBLE / n + 0.85::DOUBLE * (coalesce(g, 0) + (SELECT coalesce(sum(r), 0) FROM r{i} WHERE sink) / n) AS r "
            f"FROM every e CROSS JOIN n LEFT JOIN (SELECT dst, sum(r / o) AS g FROM edges JOIN outd USING (src) JOIN r{i} ON r{i}.id = edges.src GROUP BY dst) s ON s.dst = e.id)"
        )
    return ", ".join(parts)


def ppr_sql(seeds: str, rounds: int = ROUNDS) -> str:
    """CTEs ``p0`` .. ``p<rounds>`` from a CTE body ``seeds`` of (query_id, id)."""
    parts = [
        f"seeds AS MATERIALIZED ({seeds})", "pids AS MATERIALIZED (SELECT src AS id FROM edges UNION SELECT dst FROM edges)", "pout AS MATERIALIZED (SELECT src, count(*) AS o FROM edges GROUP BY 1)",
        "base AS MATERIALIZED (SELECT query_id, id, 1.0::DOUBLE / count(*) OVER (PARTITION BY query_id) AS s FROM (SELECT DISTINCT query_id, id FROM seeds JOIN pids USING (id)) "
        "UNION ALL SELECT NULL, id, 1.0::DOUBLE / (SELECT count(*) FROM pids) FROM pids)", "p0 AS MATERIALIZED (SELECT query_id, id, s AS r FROM base)",
    ]
    for i in range(rounds):
        parts.append(
            f"p{i + 1} AS MATERIALIZED (SELECT query_id, id, sum(x) AS r FROM (SELECT query_id, dst AS id, 0.85::DOUBLE * r / o AS x FROM edges JOIN pout USING (src) JOIN p{i} ON p{i}.id = edges.src "
            "UNION ALL SELECT query_id, id, 0.15::DOUBLE * s FROM base) GROUP BY query_id, id)"
        )
    return ", ".join(parts)


def communities_sql(rounds: int = 8) -> str:
    parts = [IDS, BOTH, "l0 AS MATERIALIZED (SELECT id, id AS c FROM ids)"]
    for i in range(rounds):
        parts.append(
            f"l{i + 1} AS MATERIALIZED (SELECT id, c FROM (SELECT id, c, row_number() OVER (PARTITION BY id ORDER BY count(*) DESC, c) AS rn FROM "
            f"(SELECT dst AS id, c FROM both_ways JOIN l{i} ON l{i}.id = src UNION ALL SELECT id, c FROM l{i}) GROUP BY id, c) WHERE rn = 1)"
        )
    return ", ".join(parts)


ORACLES = {
    "q_link_scan": f"WITH {EDGES} SELECT src, dst FROM edges",
    "q_nodes": f"WITH {EDGES}, {IDS} SELECT id FROM ids",
    "q_undirected": f"WITH {EDGES} SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM edges WHERE src <> dst",
    "q_orphans": f"WITH {EDGES}, {TITLES} SELECT title FROM titles WHERE title NOT IN (SELECT dst FROM edges)",
    "q_dangling": f"WITH {EDGES}, {TITLES} SELECT DISTINCT dst AS title FROM edges WHERE dst NOT IN (SELECT title FROM titles)",
    "q_backlinks": f"WITH {EDGES} SELECT dst, string_agg(src, '|' ORDER BY src) AS sources FROM edges GROUP BY dst",
    "q_degrees": f"WITH {EDGES}, {IDS}, {INDEG} SELECT id, in_degree, (SELECT count(*) FROM edges WHERE src = id) AS out_degree FROM indeg",
    "q_upper_median": f"WITH {TRADE}, {IDS}, {INDEG}, {MEDIAN} SELECT upper_median::BIGINT AS upper_median FROM med",
    "q_hubs": f"WITH {EDGES}, {IDS}, {INDEG}, {MEDIAN}, {HUBS} SELECT id, in_degree FROM hubs",
    "q_map_nodes": f"WITH edges AS (SELECT DISTINCT title AS src, trim(x) AS dst FROM (SELECT title, unnest(links) AS x FROM promote_overrides) WHERE title IS NOT NULL AND trim(x) <> ''), {IDS} SELECT id FROM ids WHERE id LIKE '% map' OR id = 'index'",
    "q_connectors": f"WITH {EDGES}, {IDS}, {INDEG} SELECT id FROM indeg JOIN notes ON title = id WHERE len(project) >= 2 AND in_degree >= 2",
    "q_cross_project": "SELECT title, len(project) AS n_projects FROM notes WHERE len(project) >= 2",
    "q_pagerank": f"WITH {EDGES}, {pagerank_sql()} SELECT id, round(r, 6) AS rank FROM r{ROUNDS}",
    "q_pagerank_trade": f"WITH {TRADE}, {pagerank_sql()} SELECT id::BIGINT AS id, round(r, 6) AS rank FROM r{ROUNDS}",
    "q_important": f"WITH {EDGES}, {TITLES}, {pagerank_sql()} SELECT title, round(coalesce(r, 0), 6) AS score FROM titles LEFT JOIN r{ROUNDS} ON id = title ORDER BY round(coalesce(r, 0), 9) DESC, title LIMIT 10",
    "q_ppr": f"WITH {EDGES}, {ppr_sql('SELECT note_id AS query_id, title AS id FROM notes WHERE note_id % 100 = 0')} SELECT query_id, id, round(r, 6) AS rank FROM p{ROUNDS}",
    "q_activation": f"""WITH {EDGES}, {BOTH}, s AS (SELECT title AS source, max(coalesce(access_count, 0) / 32.0::DOUBLE) AS u FROM notes WHERE title IS NOT NULL GROUP BY title HAVING u > 0),
f AS (SELECT source, u, dst AS id, 1 AS hop FROM s JOIN both_ways ON src = source WHERE u * 0.6::DOUBLE >= 0.01::DOUBLE),
t AS (SELECT source, u, id, hop FROM f UNION ALL SELECT source, u, dst, 2 FROM f JOIN both_ways ON src = id WHERE dst <> source AND u * 0.6::DOUBLE * 0.6::DOUBLE >= 0.01::DOUBLE)
SELECT source, id, min(hop) AS hop, round(u * CASE WHEN min(hop) = 1 THEN 0.6::DOUBLE ELSE 0.6::DOUBLE * 0.6::DOUBLE END, 6) AS boost FROM t GROUP BY source, u, id""",
    "q_components": f"WITH RECURSIVE {EDGES}, {IDS}, {BOTH}, reach(id, c) AS (SELECT id, id FROM ids UNION SELECT dst, c FROM reach JOIN both_ways ON src = reach.id) SELECT id, min(c) AS component FROM reach GROUP BY id",
    "q_communities": f"WITH {EDGES}, {communities_sql()} SELECT id, c AS community FROM l8",
    "q_community_stats": f"WITH {EDGES}, {communities_sql()} SELECT c AS community, count(*) AS size, string_agg(id, '|' ORDER BY id) AS members FROM l8 GROUP BY c",
    "q_top_hubs_trade": f"WITH {TRADE}, {IDS}, {INDEG} SELECT id::BIGINT AS id, in_degree, row_number() OVER (ORDER BY in_degree DESC, id) AS rank FROM indeg QUALIFY rank <= 10",
    "q_betweenness": f"""WITH RECURSIVE {TRADE}, {IDS}, e AS MATERIALIZED (SELECT * FROM edges WHERE src <> dst),
d1 AS MATERIALIZED (SELECT src AS s, dst AS t, 1 AS d, 1.0::DOUBLE AS p FROM e),
d2 AS MATERIALIZED (SELECT a.s, e.dst AS t, 2 AS d, sum(a.p) AS p FROM d1 a JOIN e ON a.t = e.src WHERE a.s <> e.dst AND NOT EXISTS (SELECT 1 FROM d1 x WHERE x.s = a.s AND x.t = e.dst) GROUP BY a.s, e.dst),
u2 AS MATERIALIZED (SELECT * FROM d1 UNION ALL SELECT * FROM d2),
d3 AS MATERIALIZED (SELECT a.s, e.dst AS t, 3 AS d, sum(a.p) AS p FROM d2 a JOIN e ON a.t = e.src WHERE a.s <> e.dst AND NOT EXISTS (SELECT 1 FROM u2 x WHERE x.s = a.s AND x.t = e.dst) GROUP BY a.s, e.dst),
u3 AS MATERIALIZED (SELECT * FROM u2 UNION ALL SELECT * FROM d3),
d4 AS MATERIALIZED (SELECT a.s, e.dst AS t, 4 AS d, sum(a.p) AS p FROM d3 a JOIN e ON a.t = e.src WHERE a.s <> e.dst AND NOT EXISTS (SELECT 1 FROM u3 x WHERE x.s = a.s AND x.t = e.dst) GROUP BY a.s, e.dst),
d AS MATERIALIZED (SELECT * FROM u3 UNION ALL SELECT * FROM d4),
b AS (SELECT x.t AS v, sum(x.p * y.p / z.p) AS c FROM d x JOIN d y ON x.t = y.s JOIN d z ON z.s = x.s AND z.t = y.t WHERE z.d = x.d + y.d GROUP BY x.t)
SELECT id::BIGINT AS id, round(coalesce(c, 0) / (((SELECT count(*) FROM ids) - 1) * ((SELECT count(*) FROM ids) - 2)), 6) AS betweenness FROM ids LEFT JOIN b ON v = id""",
}
