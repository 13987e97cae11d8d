"""References to records that do not exist, at the time they were made."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notegraph.functions.text import BLANK as _BLANK
from notegraph.operators.skew import hot_keys, salted_join
from notegraph.session import cut_lineage


def link_key(link: Column) -> Column:
    """The key a written link names: blanks, double brackets, label, anchor, ``notes/`` and ``.md`` taken off.

    Letter case and blank against dash do not count. A link of which nothing is left gives null.
    """
    edge = f"^{_BLANK}+|{_BLANK}+$"
    key = F.regexp_replace(link, edge, "")
    key = F.regexp_replace(key, r"^\[\[|\]\]$", "")
    key = F.regexp_replace(key, r"(?s)[|#].*$", "")
    key = F.lower(F.regexp_replace(key, edge, ""))
    key = F.regexp_replace(key, r"^notes/", "")
    key = F.regexp_replace(F.regexp_replace(key, r"\.md$", ""), edge, "")
    key = F.regexp_replace(key, f"(?:{_BLANK}|-)+", "-")
    return F.when(F.length(key) > 0, key)


def title_key(title: Column) -> Column:
    """The key under which a title is found: like :func:`link_key` without taking anything off."""
    edge = f"^{_BLANK}+|{_BLANK}+$"
    key = F.regexp_replace(F.lower(F.regexp_replace(title, edge, "")), f"(?:{_BLANK}|-)+", "-")
    return F.when(F.length(key) > 0, key)


def parent_keys(*parents: tuple[DataFrame, str, str | None, str | None]) -> DataFrame:
    """One row per parent key: ``(_key, _lives)``, the periods in which a record of that key existed.

    Each parent is ``(table, title, added, removed)``; a table without removal times passes None. Null titles are no
    parents. Several records that share a key (names that differ in letter case only) each give a period.
    """
    spans = None
    for table, title, added, removed in parents:
        one = table.select(
            title_key(F.col(title)).alias("_key"),
            F.struct(
                (F.col(added) if added else F.lit(None)).cast("timestamp").alias("added"),
                (F.col(removed) if removed else F.lit(None)).cast("timestamp").alias("removed"),
            ).alias("_life"),
        ).where("_key is not null")
        spans = one if spans is None else spans.unionByName(one)
    return spans.groupBy("_key").agg(F.collect_set("_life").alias("_lives"))


def orphan_references(refs: DataFrame, ref_id: str, links: str, at: str, parents: DataFrame) -> DataFrame:
    """Every distinct reference ``(ref_id, at, link, state)`` that names no record alive at ``at``.

    ``state`` is ``missing`` (the key is in no parent), ``deleted`` (removed at or before ``at``) or ``late`` (added
    after ``at``). The distinct non-null keys go through a left anti-join against the parents, so a key named by a
    third of all references is tested once; its verdict returns by a salted join. A reference without ``at`` can only
    be missing. Null and empty arrays, and null, empty and blank elements, name nothing.
    """
    named = cut_lineage(
        refs.select(F.col(ref_id).alias("_ref"), F.col(at).cast("timestamp").alias("_at"), F.explode(links).alias("link"))
        .withColumn("_key", link_key(F.col("link")))
        .where("_key is not null")
        .distinct()
    )
    keys = named.select("_key").distinct()
    missing = keys.join(parents, "_key", "left_anti").select("_key", F.lit(None).cast(parents.schema["_lives"].dataType).alias("_lives"))
    verdicts = missing.unionByName(keys.join(parents, "_key"))
    back = salted_join(named, verdicts, "_key", hot_keys(named, "_key"), F.col("_ref"))
    alive = F.exists("_lives", lambda s: F.coalesce(s["added"] <= F.col("_at"), F.lit(True)) & F.coalesce(s["removed"] > F.col("_at"), F.lit(True)))
    gone = F.exists("_lives", lambda s: F.coalesce(s["removed"] <= F.col("_at"), F.lit(False)))
    state = F.when(F.col("_lives").isNull(), "missing").when(alive, None).when(gone, "deleted").otherwise("late")
    return back.select(F.col("_ref").alias(ref_id), F.col("_at").alias(at), "link", state.alias("state")).where("state is not null")


def orphan_report(orphans: DataFrame, table: str, at: str) -> DataFrame:
    """Orphan references per table, month of ``at`` (null: unknown) and state."""
    return orphans.groupBy(
        F.lit(table).alias("table_name"), F.date_format(F.col(at), "yyyy-MM").alias("period"), "state"
    ).agg(F.count(F.lit(1)).alias("n"))
