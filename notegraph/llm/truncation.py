"""Texts cut off by a field limit or in transfer: hashed logistic regression trained on artificial cuts."""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from notegraph.operators.skew import hot_keys, salted_join
from notegraph.session import cut_lineage

#: Intact texts from which training rows are made, and texts without a mark shown beside them, drawn by hash at the rate
#: that gives so many: the only bound here, everything else covers all rows.
TRAINING_TEXTS = 40_000
#: Share of cut values expected among those without closing punctuation.
PRIOR = 0.2
#: A last word that begins a word so many times as frequent is torn.
TORN = 30.0
#: Share of artificial cuts that are made to stand at the source's limit.
AT_LIMIT = 0.6
#: Dimensions of the hashed features.
DIMENSIONS = 1 << 18
#: Share of all texts from which on the shape of an unpunctuated phrase counts as that of a complete one.
RECURRENT_SHARE = 0.003
#: A text is reported as cut from this probability on.
THRESHOLD = 0.5
#: Sources with a limit up to which these are broadcast.
BROADCAST_SOURCES = 100_000
#: Characters of a word's beginnings that are listed; longer words meet by so many first ones.
BEGINNING = 48

# English function words, which keep their own identity in a sentence's skeleton.
FUNCTION_WORDS = (
    "a an the this that these those each every some any no none all both either neither most many much few more less such own other another "
    "same one two three first last next it its itself he she they we you i them us him her his their our your my who whom whose which what "
    "when where why how there here of in on at by for from to into onto over under with without within between among through during before "
    "after since until till against about across along around behind beside beyond near off out up down upon via per as than like unlike "
    "and or but nor so yet if then else unless although though while whereas whenever wherever whether because even only just also too not "
    "never always almost is are was were be been being am has have had having do does did doing will would shall should can could may might "
    "must let left right nobody somebody everybody nothing something everything anything"
).split()

_MARK = r"(?:[\s �]*(?:\.{2,}|…|\[(?:\.{2,}|…|more|cut|truncated)\]|\((?:\.{2,}|…|more|cut|truncated)\)|�))*[\s �]*$"
_CLOSED = r"[.!?。！？][\"'”’)\]`]*$"


def bare(text: Column) -> Column:
    """A text without the marks that a cut may leave behind: dots of omission, ``[more]``, damaged characters, blanks."""
    return F.regexp_replace(text, _MARK, "")


_WORD = re.compile(r"[\w'’-]+")
_CLAUSE = re.compile(r"[,;:()\"“”.!?]")
_KNOWN = frozenset(FUNCTION_WORDS)


def _shape(word: str) -> str:
    if word in _KNOWN or word == "^":
        return word
    return "Y" if word.endswith("ly") else "D" if word.endswith("ed") else "S" if word.endswith("s") else "X"


def features(text: str, length: int, limit: int | None, share: float | None, longer: float | None) -> list[str]:
    """Feature strings of a text's end: closing characters, last words, the skeleton of the last clause, brackets left
    open, how frequent the last word is in the corpus, and how the length stands to the source's limit.

    ``text`` is bare and without its final full stop; ``length`` is that of the value as stored; ``share`` is the last
    word's share of all words of the corpus, ``longer`` that of the most frequent word it begins. All of a text counts
    for open brackets, its last clause for the rest.
    """
    low = text.lower()
    words = ["^"] * 3 + _WORD.findall(low[-200:])
    inside = [_shape(w) for w in _WORD.findall(_CLAUSE.split(low.rstrip(" ,;:()\"“”`'’"))[-1])]
    last = text[-1:]
    kind = "letter" if last.isalpha() else "digit" if last.isdigit() else last
    quotes = f"{text.count(chr(34)) % 2}{text.count('`') % 2}{text.count('“') > text.count('”')}"
    reach = "none" if limit is None else "at" if length == limit else "over" if length > limit else "near" if length >= limit - 3 else "under"
    frequent = "none" if not share else str(round(math.log2(share)))
    begins = "no" if not share or not longer or longer <= share else str(min(8, int(math.log2(longer / share))))
    w1, w2, w3 = words[-1], words[-2], words[-3]
    given = {
        "end": kind, "w1": w1, "w2": f"{w2} {w1}", "s2": f"{_shape(w2)} {w1}", "s3": f"{_shape(w3)} {_shape(w2)} {w1}", "skeleton": " ".join(inside[-12:]),
        "f1": _shape(w1), "len1": min(len(w1), 12), "p1": w1[-3:], "round": text.count("(") > text.count(")"), "odd": quotes, "often": frequent, "begins": begins, "beginslen": f"{begins} {min(len(w1), 6)}", "oftenlen": f"{frequent} {min(len(w1), 6)}",
    } | {f"k{k}": " ".join(inside[-k:]) for k in (3, 4, 5, 6, 8)}
    return [f"{k}={v}" for k, v in given.items()] + [f"reach={reach}"]


def whole_skeleton(text: str | None) -> str | None:
    """The skeleton of a text that is one clause of four words or more and ends in a letter, with no function word last,
    after which a sentence goes on; None for others."""
    text = (text or "").strip()
    if not text[-1:].isalpha() or _CLAUSE.search(text):
        return None
    words = _WORD.findall(text.lower())
    return " ".join(map(_shape, words)) if len(words) >= 4 and words[-1] not in _KNOWN else None


def described(df: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """One row per key with a non-blank text (the greatest of a repeated key): ``_key, _source`` (lower-cased), ``_text,
    _length, _t`` (bare, without its final stop), ``_closed, _marked, _last`` (the last word), ``_form`` (the skeleton of a
    text that may be a complete phrase). Written once; all that is counted, learnt and judged starts here."""
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.lower(F.trim(source)).alias("_source"), F.col(text).cast("string").alias("_text"))
    rows = rows.groupBy("_key").agg(F.max(F.struct("_text", "_source")).alias("r")).select("_key", "r._source", "r._text")
    rows = rows.where(F.length(F.regexp_replace("_text", r"[\s\u00a0\u200b\ufeff]+", "")) > 0).withColumn("_bare", bare(F.col("_text")))
    tail = F.expr("substring(_text, length(_bare) + 1)")
    rows = rows.withColumns({"_length": F.length("_text"), "_marked": F.length(F.regexp_replace(tail, r"[\s\u00a0]+", "")) > 0, "_t": F.regexp_replace("_bare", r"[.!?。！？]+$", "")})
    rows = rows.withColumns({"_closed": ~F.col("_marked") & F.col("_bare").rlike(_CLOSED), "_last": _last_word("_t")}).drop("_bare")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            forms = pa.array([whole_skeleton(t) for t in batch.column(batch.schema.names.index("_text")).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, forms], [*batch.schema.names, "_form"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return cut_lineage(rows.mapInArrow(run, f"{schema}, _form string"))


def _last_word(text: str) -> Column:
    return F.regexp_extract(F.lower(text), r"([\p{L}\p{M}\p{N}_'’-]+)[^\p{L}\p{M}\p{N}_'’-]*$", 1)


def limits(rows: DataFrame, least: int = 8, excess: float = 4.0) -> DataFrame:
    """``(_source, _limit)``: the length at which a source's distinct texts pile up, over all of them.

    The longest length that at least ``least`` texts have and that is ``excess`` times as frequent as the mean of the
    lengths from 10 below to 10 above. A source without such a length has no row. Texts are told apart by their hash;
    counts are one row per source and length, so no group is large.
    """
    texts = rows.select("_source", F.length("_text").alias("_l"), F.xxhash64("_text").alias("_h")).distinct()
    counts = texts.groupBy("_source", "_l").agg(F.count(F.lit(1)).alias("_n"))
    near = W.partitionBy("_source").orderBy("_l").rangeBetween(-10, 10)
    around = counts.withColumn("_mean", (F.sum("_n").over(near) - F.col("_n")) / 20.0)
    return around.where((F.col("_n") >= least) & (F.col("_n") >= excess * F.greatest("_mean", F.lit(0.5)))).groupBy("_source").agg(F.max("_l").alias("_limit"))


def _with_limit(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Joins the limits of the sources: broadcast after their number is checked, else salted for hot sources."""
    found = cut_lineage(found)
    named = F.coalesce("_source", F.lit("\x00"))
    rows, found = rows.withColumn("_of", named), found.select(named.alias("_of"), "_limit")
    if found.count() <= BROADCAST_SOURCES:
        return rows.join(F.broadcast(found), "_of", "left").drop("_of")
    return salted_join(rows, found, "_of", hot_keys(rows, "_of"), F.col("_key"), "left").drop("_of")


def word_shares(texts: DataFrame) -> DataFrame:
    """``(_last, _share, _longer)`` of every word and every beginning of a word, over all distinct texts: its share of all
    words (that of a single occurrence if it never stands alone) and the share of the most frequent word it begins.

    Beginnings are listed up to ``BEGINNING`` characters; words longer than that meet the words they begin by their first
    so many.
    """
    words = texts.select(F.explode(F.split(F.lower("_text"), r"[^\p{L}\p{M}\p{N}_'’-]+")).alias("_last")).where(F.length("_last") > 0)
    counts = cut_lineage(words.groupBy("_last").agg(F.count(F.lit(1)).alias("_n")))
    total = float(counts.agg(F.sum("_n")).first()[0] or 1)
    begins = F.transform(F.sequence(F.lit(1), F.least(F.length("_last") - 1, F.lit(BEGINNING))), lambda i: F.substring("_last", F.lit(1), i))
    none = F.lit(None).cast("bigint")
    starts = counts.where(F.length("_last") > 1).select(F.explode(begins).alias("_last"), F.lit(1).cast("bigint").alias("_n"), F.col("_n").alias("_m"))
    long = counts.where(F.length("_last") > BEGINNING).withColumn("_head", F.substring("_last", 1, BEGINNING))
    further = long.select("_head", F.col("_last").alias("_w"), F.col("_n").alias("_m"))
    far = long.join(further, "_head").where((F.length("_w") > F.length("_last")) & F.col("_w").startswith(F.col("_last"))).select("_last", "_n", "_m")
    most = counts.select("_last", "_n", none.alias("_m")).unionByName(starts).unionByName(far).groupBy("_last").agg(F.max("_n").alias("_n"), F.max("_m").alias("_m"))
    return cut_lineage(most.select("_last", (F.col("_n") / total).alias("_share"), (F.col("_m") / total).alias("_longer")))


def _featured(rows: DataFrame, carry: list[str]) -> DataFrame:
    """Adds ``words``, the hashed features, that on the source's limit last, to rows with ``_t``, ``_length``, ``_limit``,
    ``_share`` and ``_longer``. In Arrow batches: interpreted higher-order functions over the same splits took ten times as
    long."""
    kept = [f for f in rows.schema.fields if f.name in carry]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            given = [batch.column(batch.schema.names.index(c)).to_pylist() for c in ("_t", "_length", "_limit", "_share", "_longer")]
            words = [[zlib.crc32(f.encode()) % DIMENSIONS for f in features(*x)] for x in zip(*given)]
            arrays = [*(batch.column(batch.schema.names.index(f.name)) for f in kept), pa.array(words, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(arrays, [*(f.name for f in kept), "words"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return rows.mapInArrow(run, f"{schema}, words array<int>")


def _drawn(df: DataFrame, by: Column, n: int, bound: int) -> DataFrame:
    """Of ``n`` rows, those whose hash falls below the rate that gives about ``bound``: no sort, no last task."""
    rate = int(1_000_000 * min(1.0, bound / max(1, n)))
    return df if rate >= 1_000_000 else df.where(F.pmod(F.xxhash64(by, F.lit("drawn")), F.lit(1_000_000)) < rate)


def _odds(share: float, *by: str) -> Column:
    """The limit of a training row: its own length for ``share`` of them, so that they stand at their limit."""
    return F.when(F.pmod(F.xxhash64(*by, F.lit("limit")), F.lit(1000)) < int(share * 1000), F.col("_length")).otherwise(F.col("_limit"))


def training_rows(texts: DataFrame, bound: int = TRAINING_TEXTS, share: float = RECURRENT_SHARE, least: int = 10) -> DataFrame:
    """Labelled rows from intact texts: of several words, ending in closing punctuation or in a recurrent form.

    ``texts`` has a row per distinct text. A form is recurrent when ``share`` of all texts have it: complete phrases such
    as titles. A cut falls anywhere, so what it leaves does not recur; a text at its source's limit is not taken for one,
    as it may be cut there. Each intact text gives itself without its final mark as a negative and three positives: cut at
    a place drawn from the hash of the text, inside a word or between words. About ``bound`` texts are drawn by hash.
    """
    phrases = F.col("_form").isNotNull() & ~F.coalesce(F.col("_length") == F.col("_limit"), F.lit(False))
    counts = texts.where(phrases).groupBy("_form").agg(F.count(F.lit(1)).alias("_n"))
    common = [r[0] for r in counts.where(F.col("_n") >= max(least, share * texts.count())).orderBy(F.desc("_n")).limit(int(1 / share)).collect()]
    recurs = phrases & F.col("_form").isin(common) if common else F.lit(False)
    intact = texts.where((F.col("_closed") | recurs) & (F.size(F.split(F.trim("_text"), r"\s+")) >= 4))
    base = _drawn(intact, F.col("_text"), intact.count(), bound).select("_text", "_limit", F.regexp_replace(F.trim("_text"), r"[.!?。！？]+$", "").alias("_t"))
    sized = base.withColumn("_length", F.length("_t"))
    negative = sized.select("_t", F.lit(0.0).alias("label"), "_length", _odds(AT_LIMIT / 4, "_text").alias("_limit"))
    drawn = base.select("_t", "_limit", "_text", F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("_i"))
    at = F.lit(6) + F.pmod(F.xxhash64("_text", "_i"), F.greatest(F.length("_t") - 7, F.lit(1)))
    piece = drawn.select("_text", "_i", "_limit", "_t", F.rtrim(F.substring("_t", F.lit(1), at.cast("int"))).alias("_p"))
    between = F.regexp_replace("_p", r"[^\p{L}\p{N}]*[\p{L}\p{N}'’-]+$", "")
    piece = piece.withColumn("_p", F.when((F.col("_i") == 2) & (F.length(between) > 5), between).otherwise(F.col("_p")))
    # A cut after which nothing is missing, or only a phrase that may be left out, is no clear positive.
    rest = F.expr("substring(_t, length(_p) + 1)")
    closed = rest.rlike(r"^[^\p{L}\p{N})\]\"”`’]*$") | rest.rlike(r"^\s*[,;(–-]") | (rest.rlike(r"^\s*(?:for|as with|and|because|until|while|where|which|so that|although|even though|whenever|but|or|with|without|since|during|before|after|near|over|unlike)\b"))
    piece = piece.where(~closed & (F.length("_p") > 3)).withColumn("_length", F.length("_p"))
    positive = piece.select(F.col("_p").alias("_t"), F.lit(1.0).alias("label"), "_length", _odds(AT_LIMIT, "_text", "_i").alias("_limit"))
    return negative.unionByName(positive).withColumn("_last", _last_word("_t"))


def score_truncation(df: DataFrame, key: str, text: str, source: str, bound: int = TRAINING_TEXTS, prior: float = PRIOR) -> DataFrame:
    """``(key, source, p_cut, is_cut)`` for every distinct key with a non-blank text.

    ``source`` is lower-cased (null stays null). Null, empty and blank texts are no cases and have no row. With no intact
    text to learn from, only marks of omission and damaged ends count.

    The model judges every text. Three exact checks follow: a text that ends in closing punctuation is complete; one
    after which a mark of omission or damage stands is cut, and so is one whose last word is torn off a word ``TORN``
    times as frequent.

    Two models are added up. One sets artificial cuts against intact values. The other sets them against the values as
    they are that end without a mark, most of which are complete: these teach it the forms complete values end in where
    no mark shows it, and what standing at the source's limit means. So that it judges no value it was shown, it is
    trained twice, on either half of these by text, and scores the other half. Copies of a text count once in all that is
    counted or learnt. ``prior`` is the share of cut ones among such values at which the threshold is set.
    """
    live = described(df, key, text, source)
    live = _with_limit(live, limits(live))
    # A text that several sources have is taken once, where it stands at a limit if it does so anywhere.
    at = F.coalesce(F.col("_length") == F.col("_limit"), F.lit(False))
    one = F.max(F.struct(at.alias("at"), "_limit", "_length", "_closed", "_form")).alias("r")
    texts = cut_lineage(live.groupBy("_text").agg(one).select("_text", "r._limit", "r._length", "r._closed", "r._form"))
    shares = word_shares(texts.select("_text"))
    hot = hot_keys(live, "_last")
    given = live.select("_key", "_source", "_closed", "_marked", "_t", "_length", "_limit", "_last").withColumn("_fold", F.pmod(F.xxhash64("_t"), F.lit(2)).cast("int"))
    given = salted_join(given, shares, "_last", hot, F.col("_t"), "left").withColumn("_h", F.xxhash64("_t"))
    torn = (F.coalesce(F.col("_longer") / F.col("_share"), F.lit(0.0)) >= TORN) & F.col("_t").rlike(r"\p{L}$") & ~F.col("_last").isin(FUNCTION_WORDS)
    given = cut_lineage(_featured(given.withColumn("_torn", torn), ["_key", "_source", "_closed", "_marked", "_torn", "_fold", "_h"]))
    train = salted_join(training_rows(texts, bound), shares, "_last", hot, F.col("_t"), "left")
    y, x, _ = _collected(_featured(train, ["label"]).select("label", "words", F.lit(-1).alias("_fold")))
    loose = given.where(~F.col("_closed") & ~F.col("_marked"))
    n = loose.agg(F.approx_count_distinct("_h")).first()[0]
    loose = _drawn(loose, F.col("_h"), n, bound).groupBy("_h").agg(F.min(F.struct("_fold", "words")).alias("r"))
    _, open_x, open_fold = _collected(loose.select(F.lit(0.0).alias("label"), "r.words", "r._fold"))
    cuts, intact = int((y == 1).sum()), int((y == 0).sum())
    models: list[np.ndarray] = []
    if cuts and intact:
        base = fit_logistic(x[:, :-1], y, np.where(y == 1, intact / cuts, 1.0))
        for fold in (0, 1):
            more = open_x[open_fold != fold]
            weights = np.concatenate([np.where(y == 1, 2 * prior * max(len(more), 1) / cuts, 1.0), np.ones(len(more))])
            other = fit_logistic(np.concatenate([x, more]), np.concatenate([y, np.zeros(len(more))]), weights) if len(more) else np.zeros(DIMENSIONS + 1)
            models.append(np.stack([base, other]).astype("f4"))
    shared = df.sparkSession.sparkContext.broadcast(models)

    def judge(batches):
        import pyarrow as pa

        for batch in batches:
            marks, ends, torn, folds = (batch.column(c).to_numpy(zero_copy_only=False) for c in (2, 3, 4, 5))
            p = np.where(marks, 1.0, 0.0)
            if shared.value and batch.num_rows:
                x = batch.column(6).flatten().to_numpy().reshape(batch.num_rows, -1)
                both = np.stack([m[0][x[:, :-1]].sum(1) + m[0][-1] + m[1][x].sum(1) + m[1][-1] for m in shared.value])
                p = 1 / (1 + np.exp(-np.clip(both[folds, np.arange(len(folds))], -50, 50)))
                p = np.where(ends, 0.0, np.where(marks, np.maximum(p, 0.9), np.where(torn, np.maximum(p, 0.75), p)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p, pa.float64())], ["_key", "_source", "p_cut"])

    kind = df.schema[key].dataType.simpleString()
    scored = given.select("_key", "_source", "_marked", "_closed", "_torn", "_fold", "words").mapInArrow(judge, f"_key {kind}, _source string, p_cut double")
    return scored.select(F.col("_key").alias(key), F.col("_source").alias(source), "p_cut", (F.col("p_cut") >= THRESHOLD).alias("is_cut"))


def _collected(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Labels, features and folds of training rows, whose number the caller has bounded; in a fixed order."""
    table = rows.toArrow().combine_chunks()
    n = table.num_rows
    if not n:
        return np.zeros(0), np.zeros((0, 1), "i4"), np.zeros(0, "i4")
    words = table.column(1).combine_chunks()
    words = (words.chunk(0) if hasattr(words, "chunk") else words).flatten().to_numpy().reshape(n, -1)
    order = np.lexsort(words.T[::-1])
    return table.column(0).to_numpy()[order], words[order], table.column(2).to_numpy()[order]


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, epochs: int = 12, rate: float = 0.3, decay: float = 1e-5, seed: int = 5) -> np.ndarray:
    """Logistic regression over hashed binary features (indices, one row a case) by AdaGrad; the last weight is the bias."""
    w, seen = np.zeros(DIMENSIONS + 1), np.full(DIMENSIONS + 1, 1e-8)
    x = np.concatenate([x, np.full((len(x), 1), DIMENSIONS, x.dtype)], axis=1)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for start in range(0, len(x), 256):
            rows = order[start : start + 256]
            part = x[rows]
            p = 1 / (1 + np.exp(-np.clip(w[part].sum(1), -30, 30)))
            near, place = np.unique(part, return_inverse=True)
            step = np.bincount(place.ravel(), np.repeat((p - y[rows]) * weight[rows], part.shape[1]), len(near)) / len(rows) + decay * w[near]
            seen[near] += step * step
            w[near] -= rate * step / np.sqrt(seen[near])
    return w


def truncation_rates(scored: DataFrame, key: str, source: str) -> DataFrame:
    """Per source: texts, cut texts and their share."""
    cut = F.sum(F.col("is_cut").cast("long"))
    return scored.groupBy(source).agg(F.count(key).alias("n"), cut.alias("n_cut"), (cut / F.count(key)).alias("cut_share"))
