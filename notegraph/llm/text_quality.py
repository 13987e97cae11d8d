"""Per-document text statistics, and a Gaussian mixture over them that tells prose from lists, tables and junk."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notegraph.llm.quality_examples import EXAMPLES
from notegraph.session import cut_lineage

# Frequent function words of English, German, French, Spanish, Italian, Portuguese and Dutch.
COMMON_WORDS = frozenset(
    (
        "the of and to in a is that it for on was were as with by this which there each one every no not but so if when what we you are be at "
        "from or an our us than then they has have had its will would before after only until while because although their them he she his "
        "der die das und ist nicht ein eine einen den dem des zu mit von auf für im wir haben sich dass ohne niemand mehr er hat wurde nach vor "
        "weil ob obwohl auch aber wie als bei aus wird war sind es "
        "le la les de du un une et est que qui dans pour pas nous on sans plus ne se ce il elle au aux avec avant après car sur même ont été "
        "el los las una y en por sin con para del al más lo como ya su se porque aunque antes después nadie esta este era "
        "il di che non per del della sono gli si da com não uma os as ao do da em mais foi "
        "het een van niet met voor dat zijn werd maar ook aan door over"
    ).split()
)

SPACE, LINE, LOWER, UPPER, DIGIT, STOP, PAUSE, QUOTE, SYMBOL, OTHER, DAMAGED = range(11)


def _classes() -> np.ndarray:
    table = np.full(0x10000, OTHER, dtype=np.uint8)
    for code in range(0x10000):
        c, kind = chr(code), unicodedata.category(chr(code))
        if c == "\n" or c == "\r":
            table[code] = LINE
        elif c in "\t " or kind == "Zs":
            table[code] = SPACE
        elif kind in ("Lu", "Lt"):
            table[code] = UPPER
        elif kind[0] == "L" or kind[0] == "M":
            table[code] = LOWER
        elif kind[0] == "N":
            table[code] = DIGIT
        elif c in ".!?。！？…":
            table[code] = STOP
        elif c in ",;:、":
            table[code] = PAUSE
        elif kind in ("Pi", "Pf") or c in "'\"()-":
            table[code] = QUOTE
        elif code < 0x80 and kind != "Cc":
            table[code] = SYMBOL
        elif kind in ("Cc", "Co", "Cn", "Cs") or code == 0xFFFD:
            table[code] = DAMAGED
    return table


_TABLE: list[np.ndarray] = []
_MARKER = re.compile(r"\s*(?:[-*+•–—→»✓‣▪◦·]\s+|\[[ xX]\]\s|\(?(?:\d{1,3}|[a-zA-Z])[.)]\s|\[\d{1,3}\]\s|\d{1,3}\s+[-–]\s)")
_MOJIBAKE = re.compile(r"Ã[-¿]|Â[-¿]|â€.?|ðŸ|Ð[^\sA-Za-z]|ï¿½")
_CELLS = re.compile(r"\s*\|\s*|\s*│\s*|\t|\"?;\"|(?<=\S)\s{2,}(?=\S)|(?<=[^\s,]),(?=[^\s,])|,,")
_SENTENCE = re.compile(r"[.!?。]+\s+|[\r\n]+")
_ENTRY = re.compile(r"\s·\s|;\s|,\s|\s\|\s|\s/\s")

#: The statistics, in the order of the vectors.
STATISTICS = (
    "n_words", "n_lines", "mean_word_length", "words_per_line", "symbol_ratio", "digit_ratio", "upper_ratio", "punct_line_share",
    "common_word_share", "marker_line_share", "cell_line_share", "entry_share", "distinct_word_share", "distinct_line_share",
    "single_letter_share", "damaged_ratio", "stop_ratio", "mixed_case_share", "short_line_share", "link_share", "long_word_share", "vowel_ratio", "distinct_sentence_share",
)


def statistics(text: str | None) -> list[float] | None:
    """The statistics of one text; None for a null, empty or blank one. The whole text counts, whatever its length."""
    if not text:
        return None
    words = text.split()
    if not words:
        return None
    if not _TABLE:
        _TABLE.append(_classes())
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    kinds = _TABLE[0][np.minimum(codes, 0xFFFF)]
    kinds = np.where(codes > 0xFFFF, OTHER, kinds) if codes.max() > 0xFFFF else kinds
    n = np.bincount(kinds, minlength=11)
    ink = max(1, len(codes) - n[SPACE] - n[LINE])
    letters = n[LOWER] + n[UPPER]
    low = text.lower()
    lows = low.split()
    w = len(words)
    gap = kinds <= LINE
    letter = (kinds == LOWER) | (kinds == UPPER)
    before, behind = np.concatenate([[True], gap[:-1]]), np.concatenate([gap[1:], [True]])
    single = int((letter & before & behind).sum())
    mixed = int(((kinds[1:] == UPPER) & (kinds[:-1] == LOWER)).sum()) + int(((kinds[1:] == DIGIT) & letter[:-1]).sum())
    lines = [x for x in text.splitlines() if x and not x.isspace()]
    marked = celled = ended = short = entries = 0
    total = 0
    for x in lines:
        size = len(x)
        total += size
        last = x.rstrip()[-1:]
        if last in ".!?。！？:…\"”’)":
            ended += size
        if _MARKER.match(x):
            marked += 1
        if size < 60:
            short += size
        if (_may_have_cells(x) and len(_CELLS.findall(x)) >= 2) or x.startswith("+--"):
            celled += 1
    if len(lines) <= max(3, w / 12):
        entries = len(_ENTRY.findall(text))
    sentences = [y for x in _SENTENCE.split(low) if (y := x.strip())]
    damaged = int(n[DAMAGED])
    if not text.isascii():
        damaged += 2 * len(_MOJIBAKE.findall(text))
    vowels = sum(map(low.count, "aeiouyäöüéèáíóú"))
    return [
        float(w), float(len(lines)), letters / w, w / len(lines), (n[SYMBOL] + n[OTHER]) / ink, n[DIGIT] / ink, n[UPPER] / max(1, letters), ended / total,
        sum(map(COMMON_WORDS.__contains__, lows)) / w, marked / len(lines), celled / len(lines), entries / w, len(set(lows)) / w, len(set(lines)) / len(lines),
        single / w, min(1.0, damaged / ink), n[STOP] / w, mixed / w, short / total, text.count("[[") / w, sum(len(x) > 24 for x in words) / w, vowels / max(1, letters), len(set(sentences)) / max(1, len(sentences)),
    ]


def _may_have_cells(line: str) -> bool:
    """Whether a line has anything that may part two cells: most lines of prose need no further look."""
    return not line.isascii() or "|" in line or "\t" in line or "  " in line or '";' in line or line.count(",") - line.count(", ") > 1


def document_statistics(docs: DataFrame, key: str, text: str) -> DataFrame:
    """One row per distinct key with a column per statistic; null for null, empty and blank texts. Narrow, no shuffle.

    A key that occurs more than once must carry the same text; null keys are dropped. Extra columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [statistics(t) for t in batch.column(1).to_pylist()]
            columns = [pa.array([None if s is None else s[j] for s in found], pa.float64()) for j in range(len(STATISTICS))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["key", *STATISTICS])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    out = rows.mapInArrow(run, f"key {kind}, " + ", ".join(f"{s} double" for s in STATISTICS))
    return out.withColumnRenamed("key", key)


def vector(s: np.ndarray) -> np.ndarray:
    """Statistics (rows in the order of ``STATISTICS``) as the features of the mixture: the same, tamed and free of length."""
    c = {name: s[:, j] for j, name in enumerate(STATISTICS)}
    root = np.sqrt
    return np.stack(
        [
            np.minimum(c["mean_word_length"], 14.0), np.log1p(np.minimum(c["words_per_line"], 40.0)), root(c["symbol_ratio"]), root(c["digit_ratio"]),
            c["punct_line_share"], c["common_word_share"], c["marker_line_share"], c["cell_line_share"], root(np.minimum(c["entry_share"], 0.6)),
            np.log1p(c["distinct_word_share"] * c["n_words"]) / np.log1p(c["n_words"]), c["distinct_sentence_share"], root(c["single_letter_share"]), root(c["damaged_ratio"]),
            root(np.minimum(c["stop_ratio"], 0.3)), root(np.minimum(c["mixed_case_share"], 2.0)), c["short_line_share"], root(np.minimum(c["link_share"], 0.5)),
            root(c["long_word_share"]), c["vowel_ratio"],
        ],
        axis=1,
    )


@dataclass
class Mixture:
    """Gaussian components with diagonal covariance over standardised features, each with the kind it stands for."""

    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    means: np.ndarray
    variances: np.ndarray
    kinds: list[str]

    def log_density(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.centre) / self.scale
        out = np.empty((len(z), len(self.weights)))
        for k in range(len(self.weights)):
            out[:, k] = -0.5 * (((z - self.means[k]) ** 2 / self.variances[k]).sum(1) + np.log(self.variances[k]).sum())
        return out + np.log(self.weights)

    def posterior(self, x: np.ndarray) -> np.ndarray:
        d = self.log_density(x)
        d = np.exp(d - d.max(1, keepdims=True))
        return d / d.sum(1, keepdims=True)

    def classify(self, x: np.ndarray) -> list[str]:
        names = sorted(set(self.kinds))
        p = self.posterior(x)
        by = np.stack([p[:, [i for i, k in enumerate(self.kinds) if k == name]].sum(1) for name in names], axis=1)
        return [names[i] for i in by.argmax(1)]


def fit_mixture(stats: DataFrame, rounds: int = 20, floor: float = 0.1, prior_rows: float = 1.0, tolerance: float = 1e-2) -> Mixture:
    """Expectation-maximisation over all rows of ``stats`` (written once, read each round).

    Components start at the inspected examples, one per family of them; each round sums responsibilities in the
    partitions, and only components x features numbers reach the driver. Afterwards a component is mapped to the kind
    whose examples it takes most of (its own family's kind if it takes none). ``floor`` bounds variances from below;
    ``prior_rows`` rows at its examples keep a component defined to which no row falls. Rounds end when the mean log
    likelihood of a row gains less than ``tolerance``.
    """
    families = [(kind, vector(np.array([s for s in map(statistics, texts) if s]))) for kind, texts in EXAMPLES]
    rows = stats.where(F.col(STATISTICS[0]).isNotNull()).select(*STATISTICS)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, q = 0, 0.0, 0.0
        for batch in batches:
            x = _matrix(batch)
            n, s, q = n + len(x), s + x.sum(0), q + (x * x).sum(0)
        if n:
            d = len(s)
            yield pa.RecordBatch.from_arrays([pa.array([0] * d), pa.array(list(range(d))), pa.array([float(n)] * d), pa.array(s), pa.array(q)], ["c", "j", "n", "s", "q"])

    def gathered(step) -> np.ndarray:
        sums = rows.mapInArrow(step, "c bigint, j bigint, n double, s double, q double").groupBy("c", "j").agg(F.sum("n"), F.sum("s"), F.sum("q"))
        return np.array([tuple(r) for r in sums.collect()])

    found = gathered(moments)
    dims = families[0][1].shape[1]
    centre, scale = np.zeros(dims), np.ones(dims)
    for _, j, n, s, q in found:
        centre[int(j)] = s / n
        scale[int(j)] = np.sqrt(max(q / n - (s / n) ** 2, 0.01))
    means = np.stack([((x - centre) / scale).mean(0) for _, x in families])
    prose = sum(kind == "prose" for kind, _ in families)
    weights = np.array([0.8 / prose if kind == "prose" else 0.2 / (len(families) - prose) for kind, _ in families])
    mix = Mixture(centre, scale, weights, means, np.full_like(means, 0.5), [kind for kind, _ in families])
    start, last = means, -np.inf
    for _ in range(rounds if len(found) else 0):

        def expect(batches: Iterator[pa.RecordBatch], mix: Mixture = mix) -> Iterator[pa.RecordBatch]:
            k = len(mix.weights)
            n, s, q, fit = np.zeros(k), np.zeros((k, dims)), np.zeros((k, dims)), 0.0
            for batch in batches:
                x = _matrix(batch)
                d = mix.log_density(x)
                top = d.max(1, keepdims=True)
                p = np.exp(d - top)
                total = p.sum(1, keepdims=True)
                fit += float((top + np.log(total)).sum())
                p /= total
                z = (x - mix.centre) / mix.scale
                n, s, q = n + p.sum(0), s + p.T @ z, q + p.T @ (z * z)
            c, j = np.divmod(np.arange(k * dims), dims)
            arrays = [np.append(c, -1), np.append(j, 0), np.append(np.repeat(n, dims), n.sum()), np.append(s.ravel(), fit), np.append(q.ravel(), 0.0)]
            yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], ["c", "j", "n", "s", "q"])

        sums = gathered(expect)
        k = len(mix.weights)
        n, s, q = np.zeros(k), np.zeros((k, dims)), np.zeros((k, dims))
        total, fit = 1.0, 0.0
        for c, j, a, b, e in sums:
            if c < 0:
                total, fit = a, b / a
            else:
                n[int(c)], s[int(c), int(j)], q[int(c), int(j)] = a, b, e
        held = prior_rows
        means = (s + held * start) / (n + held)[:, None]
        spread = q - 2 * means * s + n[:, None] * means**2
        variances = (spread + held * ((means - start) ** 2 + 0.3)) / (n + held)[:, None]
        mix = Mixture(centre, scale, np.maximum(n, 1e-3) / max(total, 1.0), means, np.maximum(variances, floor), mix.kinds)
        if abs(fit - last) < tolerance:
            break
        last = fit
    takes: list[dict[str, float]] = [{} for _ in mix.kinds]
    for kind, x in families:
        for k, p in enumerate(mix.posterior(x).mean(0)):
            takes[k][kind] = takes[k].get(kind, 0.0) + p
    mix.kinds = [max(t, key=t.get) if max(t.values()) > 0.5 else own for t, own in zip(takes, mix.kinds)]
    return mix


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return vector(np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1))


def classify_documents(docs: DataFrame, key: str, text: str, rounds: int = 20) -> DataFrame:
    """``(key, kind, *STATISTICS)``: the statistics with ``kind`` prose, list, table or junk.

    Null, empty and blank texts have null statistics and a null kind. An empty table gives an empty result.
    """
    stats = cut_lineage(document_statistics(docs, key, text))
    mix = fit_mixture(stats, rounds)
    shared = docs.sparkSession.sparkContext.broadcast(mix)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = batch.columns[1:]
            known = np.asarray(columns[0].is_valid())
            kinds: list[str | None] = [None] * batch.num_rows
            if known.any():
                x = vector(np.stack([c.to_numpy(zero_copy_only=False)[known] for c in columns], axis=1))
                for i, kind in zip(np.nonzero(known)[0], shared.value.classify(x)):
                    kinds[i] = kind
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kinds, pa.string()), *columns], ["key", "kind", *STATISTICS])

    kind = docs.schema[key].dataType.simpleString()
    out = stats.mapInArrow(run, f"key {kind}, kind string, " + ", ".join(f"{s} double" for s in STATISTICS))
    return out.withColumnRenamed("key", key)
