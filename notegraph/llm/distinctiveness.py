"""How characteristic a term is of a record: residual inverse document frequency times the term's frequency."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from notegraph.operators.skew import hot_keys


def residual_idf(postings: DataFrame, term: str, record: str, tf: str, records: int | None = None) -> DataFrame:
    """``(term, record, tf, df, cf, ridf, score)`` for every distinct posting.

    ``idf = -log2(df / N)`` is compared with what a Poisson process of rate ``cf / N`` would give,
    ``-log2(1 - exp(-cf / N))``; the difference is high for terms concentrated in few records and near zero for terms
    spread as chance would. ``score = ridf * tf``. N is the number of distinct records unless given.

    Repeated rows count once (the greatest tf of a term and record); a null or NaN tf counts as a posting of tf 0, so
    it gives df but no frequency; postings with a null term or record are dropped. An empty table gives an empty one.
    Hot terms are spread over term and record, and their counts, combined on the map side, broadcast back.
    """
    value = F.coalesce(F.when(~F.isnan(tf), F.col(tf).cast("double")), F.lit(0.0))
    rows = postings.where(F.col(term).isNotNull() & F.col(record).isNotNull()).select(term, record, value.alias("tf"))
    if records is None:
        records = rows.select(record).distinct().count()
    n = F.lit(float(max(records, 1)))
    hot = hot_keys(rows, term)
    # Ordinary terms: one shuffle on the term, after which repeats, counts and scores are found in place.
    cold = (rows.where(~F.col(term).isin(hot)) if hot else rows).repartition(F.col(term))
    same = W.partitionBy(term)
    once = cold.groupBy(term, record).agg(F.max("tf").alias("tf"))
    counted = once.withColumns({"df": F.count(F.lit(1)).over(same), "cf": F.sum("tf").over(same)})
    if hot:
        spread = rows.where(F.col(term).isin(hot)).groupBy(term, record).agg(F.max("tf").alias("tf"))
        stats = spread.groupBy(term).agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))
        counted = counted.unionByName(spread.join(F.broadcast(stats), term))  # as many rows as hot terms
    expected = F.when(F.col("cf") > 0, -F.log2(-F.expm1(-F.col("cf") / n))).otherwise(F.lit(0.0))
    ridf = F.when(F.col("cf") > 0, -F.log2(F.col("df") / n) - expected).otherwise(F.lit(0.0))
    return counted.withColumn("ridf", ridf).select(term, record, "tf", "df", "cf", "ridf", (F.col("ridf") * F.col("tf")).alias("score"))


def most_characteristic(scored: DataFrame, term: str, record: str, least_terms: int = 40, least_tf: float = 2.0) -> DataFrame:
    """Of each record with at least ``least_terms`` distinct terms, the term of the highest score.

    A term that occurs less than ``least_tf`` times is not meant; ties go to the rarer, then the lesser term. Partial
    maxima are taken on the map side, so a record of any number of terms is no hot group.
    """
    key = F.struct(F.col("score"), (-F.col("df")).alias("rare"), F.col("tf"))
    meant = F.when(F.col("tf") >= least_tf, F.struct(key.alias("key"), F.col(term).alias("term")))
    best = scored.groupBy(record).agg(F.count(F.lit(1)).alias("_terms"), F.max(meant).alias("_best"))
    return best.where((F.col("_terms") >= least_terms) & F.col("_best").isNotNull()).select(
        record, F.col("_best.term").alias(term), F.col("_best.key.score").alias("score")
    )
