"""The inverted index and BM25 search, for whole batches of queries."""

from __future__ import annotations

from collections import Counter
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from notegraph.functions.text import tokens
from notegraph.operators.blocks import block_pairs, blocks
from notegraph.session import cut_lineage

#: Weights of the fields of a note, and the two constants of BM25.
FIELD_WEIGHTS = {"title": 3.0, "description": 2.0, "body": 1.0}
K1, B = 1.2, 0.75


def _weighed(words: Column, w: float) -> Column:
    return F.transform(words, lambda t: F.struct(t.alias("term"), F.lit(w).alias("w")))


def postings(docs: DataFrame, key: str, weights: dict[str, float] | None = None) -> DataFrame:
    """``(key, term, tf)``: tokens counted per field, weighted and summed. Null fields have no tokens."""
    weights = FIELD_WEIGHTS if weights is None else weights
    fields = [_weighed(tokens(F.col(f)), float(w)) for f, w in weights.items()]
    rows = docs.where(F.col(key).isNotNull()).select(F.col(key), F.explode(F.concat(*fields)).alias("p"))
    return rows.groupBy(key, F.col("p.term").alias("term")).agg(F.sum("p.w").alias("tf"))


def doc_lengths(docs: DataFrame, key: str, weights: dict[str, float] | None = None) -> DataFrame:
    """``(key, dl)``: weighted number of tokens, 0 included. Narrow: no shuffle."""
    weights = FIELD_WEIGHTS if weights is None else weights
    parts = [F.size(tokens(F.col(f))) * F.lit(float(w)) for f, w in weights.items()]
    return docs.where(F.col(key).isNotNull()).select(key, sum(parts[1:], parts[0]).alias("dl"))


def corpus_stats(lengths: DataFrame) -> DataFrame:
    """One row: number of documents, empty ones included, and mean length (0 for none)."""
    return lengths.agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl"))


def document_frequency(posted: DataFrame) -> DataFrame:
    return posted.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def query_terms(queries: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, term, times)``: a repeated term counts as often as it stands there; queries without tokens have no row."""
    rows = queries.select(key, F.explode(tokens(F.col(text))).alias("term"))
    return rows.groupBy(key, "term").agg(F.count(F.lit(1)).alias("times"))


#: Distinct query terms up to which they are broadcast.
BROADCAST_TERMS = 100_000


def bm25(queries: DataFrame, query_key: str, query_text: str, docs: DataFrame, key: str, weights: dict[str, float] | None = None, k1: float = K1, b: float = B) -> DataFrame:
    """``(query_key, key, score)`` of every document that shares a term with a query.

    A document is tokenised once: its length is that of its token arrays, and of its tokens only those that some query
    has leave the scan, by a semi-join with the queries' terms, broadcast where there are at most ``BROADCAST_TERMS``.
    Term weights are computed once per posting, then queries meet postings on the term; scores are summed on the map
    side. Popular terms make large partitions on that join: adaptive execution splits them, as both sides only need to
    share the term.
    """
    asked = cut_lineage(query_terms(queries, query_key, query_text))
    weighed = _weighed_postings(asked, docs, key, weights, k1, b)
    return asked.join(weighed, "term").groupBy(query_key, key).agg(F.sum(F.col("times") * F.col("w")).alias("score"))


def _weighed_postings(asked: DataFrame, docs: DataFrame, key: str, weights: dict[str, float] | None, k1: float = K1, b: float = B) -> DataFrame:
    """``(term, key, w)``: what each asked term gives to each document that has it."""
    weights = FIELD_WEIGHTS if weights is None else weights
    terms = asked.select("term").distinct()
    few = terms.count() <= BROADCAST_TERMS
    terms = F.broadcast(terms) if few else terms
    heard = docs.where(F.col(key).isNotNull()).select(F.col(key), *[tokens(F.col(f)).alias(f"_t_{f}") for f in weights])
    dl = [F.size(f"_t_{f}") * F.lit(float(w)) for f, w in weights.items()]
    n = corpus_stats(heard.select(sum(dl[1:], dl[0]).alias("dl")))
    pairs = F.concat(*[_weighed(F.col(f"_t_{f}"), float(w)) for f, w in weights.items()])
    met = heard.select(key, sum(dl[1:], dl[0]).alias("dl"), F.explode(pairs).alias("p")).select(key, "dl", "p.term", "p.w").join(terms, "term", "left_semi")
    wanted = met.groupBy(key, "term").agg(F.sum("w").alias("tf"), F.max("dl").alias("dl"))
    frequency = document_frequency(wanted)
    weighed = wanted.join(F.broadcast(frequency) if few else frequency, "term").crossJoin(F.broadcast(n))
    idf = F.ln((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0)
    length = F.lit(1.0 - b) + F.lit(b) * F.col("dl") / F.col("avgdl")
    weight = idf * F.col("tf") * F.lit(k1 + 1.0) / (F.col("tf") + F.lit(k1) * length)
    return weighed.select("term", key, weight.alias("w"))


#: Bags and documents that meet in one group of :func:`bm25_top`.
BAGS, DOCS = 32_768, 8_192


def bm25_top(queries: DataFrame, query_key: str, query_text: str, docs: DataFrame, key: str, k: int = 10, weights: dict[str, float] | None = None) -> DataFrame:
    """The best ``k`` documents of each query: ``(query_key, key, score, rank)``.

    Queries of the same terms are answered once: each distinct bag of terms is searched and cut to ``k``, and only then
    are its queries joined. Bags meet documents block by block, where a bag's scores are a sum of its terms' postings
    and only the best ``k`` of a block leave; pairs of bags and documents are never rows.
    """
    bags = queries.select(query_key, F.array_join(F.array_sort(tokens(F.col(query_text))), " ").alias("_bag")).where("_bag <> ''")
    distinct = cut_lineage(bags.select("_bag").distinct())
    asked = distinct.select(F.explode(F.split("_bag", " ")).alias("term")).distinct()
    posted = _weighed_postings(cut_lineage(asked), docs, key, weights)
    kind = docs.schema[key].dataType.simpleString()
    found = block_pairs(distinct, "_bag", blocks(distinct.count(), BAGS), posted, key, blocks(docs.count(), DOCS), partial(_answered, key=key, k=k), f"_bag string, `{key}` {kind}, score double")
    return bags.join(top_k(found, "_bag", key, k), "_bag").drop("_bag")


def _answered(bags: pa.Table, posted: pa.Table, key: str, k: int) -> pa.Table:
    """The best ``k`` documents of a block for each bag, ties to the lesser key."""
    import numpy as np
    import pyarrow.compute as pc

    term, doc = (pc.dictionary_encode(posted[c]).combine_chunks() for c in ("term", key))
    term, doc = (x.chunk(0) if isinstance(x, pa.ChunkedArray) and x.num_chunks else x for x in (term, doc))
    names = doc.dictionary if posted.num_rows else pa.array([], posted.schema.field(key).type)
    picked, cols, scores = [], [], []
    if posted.num_rows:
        places = term.indices.to_numpy()
        order = np.argsort(places, kind="stable")
        ends = np.searchsorted(places[order], np.arange(len(term.dictionary) + 1))
        docs, gives = doc.indices.to_numpy()[order], posted["w"].to_numpy()[order]
        own = {t: slice(ends[i], ends[i + 1]) for i, t in enumerate(term.dictionary.to_pylist())}
        turn = np.empty(len(names), dtype="i8")
        turn[pc.sort_indices(names).to_numpy()] = np.arange(len(names))
        sums = np.zeros(len(names))
        for i, bag in enumerate(bags["_bag"].to_pylist()):
            for t, times in Counter(bag.split(" ")).items():
                if (s := own.get(t)) is not None:
                    sums[docs[s]] += times * gives[s]
            met = np.flatnonzero(sums)
            if not len(met):
                continue
            found = sums[met]
            if len(met) > k:
                least = np.partition(found, len(met) - k)[len(met) - k]
                near = np.flatnonzero(found >= least - 1e-8)
                near = near[np.lexsort((turn[met[near]], -np.round(found[near], 9)))[:k]]
                cols.append(met[near])
                scores.append(found[near])
            else:
                cols.append(met)
                scores.append(found)
            picked.append(np.full(len(cols[-1]), i))
            sums[met] = 0.0
    row, col, score = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((picked, "i8"), (cols, "i8"), (scores, "f8")))
    return pa.table({"_bag": bags["_bag"].take(pa.array(row)), key: names.take(pa.array(col)), "score": pa.array(score)})


def top_k(scored: DataFrame, by: str | list[str], key: str, k: int, score: str = "score", digits: int | None = 9) -> DataFrame:
    """The best ``k`` rows of each group by score, ties to the lesser key, with ``rank`` from 1.

    Spark keeps ``k`` rows a group and task before the shuffle (WindowGroupLimit). Scores are compared rounded to
    ``digits``, so that the order of summation does not decide between equals.
    """
    by = [by] if isinstance(by, str) else by
    order = F.round(score, digits) if digits else F.col(score)
    w = W.partitionBy(*by).orderBy(order.desc(), F.col(key).asc())
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
