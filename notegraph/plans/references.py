"""Queries on references to records that do not exist."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from notegraph.operators.references import orphan_references, orphan_report, parent_keys


def _orphans(spark: SparkSession, folder: str) -> DataFrame:
    notes, maps = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("notes", "map_notes"))
    refs = spark.read.parquet(f"{folder}/promote_overrides.parquet")
    parents = parent_keys((notes, "title", "added_at", "removed_at"), (maps, "title", "added_at", None))
    return orphan_references(refs, "override_id", "links", "promoted_at", parents)


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return _orphans(spark, folder).select("override_id", "link", "state").distinct()


def p6_report(spark: SparkSession, folder: str) -> DataFrame:
    return orphan_report(_orphans(spark, folder), "promote_overrides", "promoted_at")


_BLANK = r"[\s\x{00a0}\x{1680}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
_EDGE = f"^{_BLANK}+|{_BLANK}+$"


def _trim(x: str) -> str:
    return f"regexp_replace({x}, '{_EDGE}', '', 'g')"


_LINK = _trim("link")
_LINK = f"regexp_replace({_LINK}, '^\\[\\[|\\]\\]$', '', 'g')"
_LINK = f"regexp_replace({_LINK}, '[|#].*$', '', 's')"
_LINK = f"regexp_replace(lower({_trim(_LINK)}), '^notes/', '')"
_LINK = _trim(f"regexp_replace({_LINK}, '\\.md$', '')")
_LINK = f"regexp_replace({_LINK}, '({_BLANK}|-)+', '-', 'g')"
_TITLE = f"regexp_replace(lower({_trim('title')}), '({_BLANK}|-)+', '-', 'g')"

_SQL = f"""
WITH named AS (
  SELECT DISTINCT override_id, promoted_at, link, {_LINK} AS k
  FROM (SELECT override_id, promoted_at, unnest(links) AS link FROM promote_overrides) WHERE link IS NOT NULL),
parents AS (
  SELECT {_TITLE} AS k, added_at, removed_at FROM notes WHERE title IS NOT NULL
  UNION ALL SELECT {_TITLE} AS k, added_at, NULL FROM map_notes WHERE title IS NOT NULL),
judged AS (
  SELECT n.override_id, n.promoted_at, n.link, count(p.k) AS found,
         coalesce(bool_or(p.k IS NOT NULL AND coalesce(p.added_at <= n.promoted_at, true) AND coalesce(p.removed_at > n.promoted_at, true)), false) AS alive,
         coalesce(bool_or(p.removed_at <= n.promoted_at), false) AS gone
  FROM named n LEFT JOIN parents p ON n.k = p.k WHERE n.k <> '' GROUP BY ALL),
orphans AS (
  SELECT override_id, promoted_at, link, CASE WHEN found = 0 THEN 'missing' WHEN gone THEN 'deleted' ELSE 'late' END AS state FROM judged WHERE found = 0 OR NOT alive)
"""

QUERIES = {"p6_found": p6_found, "p6_report": p6_report}
ORACLES = {
    "p6_found": _SQL + "SELECT DISTINCT override_id, link, state FROM orphans",
    "p6_report": _SQL + "SELECT 'promote_overrides' AS table_name, strftime(promoted_at, '%Y-%m') AS period, state, count(*) AS n FROM orphans GROUP BY ALL",
}
