"""Toxicity (operator 4): gradient-boosted trees over dense features, with isotonic calibration.

Features of a text: densities of lexicon words, their nearness to second-person words, capitals, punctuation and
obfuscation rates. The lexicon is a short fixed list and the words and word
beginnings that tell best between the labels in the sample.

Fitting takes at most `SAMPLE` labelled rows (one for each doc_id), those of least hash of doc_id. By a hash of their texts,
so that copies stay together, three quarters teach the words and grow the trees, and one quarter, of which these know
nothing, fits the calibration. Words are counted and features made on the cluster; the driver gets at most `LEARNED` words
and one feature row for each sampled document. Scoring reads every text as a whole.

Defined results: null and empty texts have zero features and get a score like any other; null doc_ids pass (their labels
are not learned from, and they count as not held out); without labels of both kinds every score is the share of label 1, or
0.0 where there is no label at all; repeated rows each get their row; empty tables give empty results.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, read_table, slices
from .quality import held_out, sampled

SAMPLE = 12000
LEARNED = 200
LEAST_DOCS = 12
THRESHOLD = 0.7
TREES = 80
DEPTH = 3
RATE = 0.12
BINS = 32
NEAR = 6

# Insults, with no claim to be complete, and second-person words of some languages.
INSULTS = ("idiot", "moron", "stupid", "dumb", "loser", "scum", "trash", "clown", "pathetic", "worthless", "disgusting", "fool", "jerk", "garbage", "filthy", "vermin", "imbecile", "hate")
SECOND_PERSON = ("you", "your", "yours", "yourself", "u", "ur", "du", "dein", "deine", "dich", "dir", "ihr", "euch", "tu", "te", "toi", "ton", "ta", "tes", "vous", "votre", "tú", "ti", "usted", "ustedes", "vosotros")
# Characters that stand for letters.
LOOKALIKES = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": ""})

WORD = re.compile(r"[^\W_]+")
MASKED = re.compile(r"\b(?=\w*[^\W\d_])(?=[\w@$*!]*[0-9@$*!])[\w@$*!]{3,}\w\b")
STRETCHED = re.compile(r"([^\W\d_])\1{2,}")
FEATURES = (
    "insults per word", "insults per log length", "kinds of insults", "learned words per word", "learned words per log length",
    "kinds of learned words", "weight of learned words", "second person per word", "insults near second person", "capital letters",
    "words in capitals", "exclamation marks", "question marks", "other punctuation", "masked insults", "masked words", "stretched words",
    "log words", "strongest word", "learned words near second person",
)


STEMS = (4, 5, 6, 7)


def stems(word: str) -> list[str]:
    """What a word can be learned as: itself, or one of its beginnings (marked by a hyphen)."""
    return [word, *(word[:k] + "-" for k in STEMS if k < len(word))]


class Lexicon(dict):
    """Weights of words, by the strongest of their learned stems (None: none is learned)."""

    def __init__(self, learned: dict[str, float]) -> None:
        super().__init__()
        self.learned = learned

    def __missing__(self, word: str) -> float | None:
        if len(self) > 200_000:
            self.clear()
        got = self[word] = max((self.learned[s] for s in stems(word) if s in self.learned), default=None)
        return got


def features(text: str | None, lexicon: Lexicon) -> list[float]:
    """The dense features of one text."""
    text = text or ""
    lower = text.lower()
    words = WORD.findall(lower)
    n = max(1, len(words))
    bad = [i for i, w in enumerate(words) if w in _INSULTS]
    own = [i for i, w in enumerate(words) if lexicon[w] is not None]
    you = [i for i, w in enumerate(words) if w in _YOU]
    near = lambda some: sum(any(abs(i - j) <= NEAR for j in you[max(0, k - 1) : k + 1]) for i, k in zip(some, np.searchsorted(you, some), strict=True)) if you and some else 0
    weights = [lexicon[words[i]] for i in own]
    letters = max(1, sum(map(str.isalpha, text)))
    size = max(1, len(text))
    masked = MASKED.findall(lower) if any(c in lower for c in "0134578@$!*") else []
    logs = math.log(n + 2)
    return [
        len(bad) / n, len(bad) / logs, float(len({words[i] for i in bad})), len(own) / n, len(own) / logs,
        float(len({words[i] for i in own})), sum(weights) / logs, len(you) / n, near(bad) / logs, sum(map(str.isupper, text)) / letters,
        sum(map(str.isupper, text.split())) / n, text.count("!") / size, text.count("?") / size, sum(map(text.count, ".,;:-()\"'")) / size,
        float(sum(w.translate(LOOKALIKES) in _INSULTS or lexicon[w.translate(LOOKALIKES)] is not None for w in masked)), len(masked) / n,
        len(STRETCHED.findall(lower)) / n, logs, max(weights, default=0.0), near(own) / logs,
    ]


_INSULTS, _YOU = frozenset(INSULTS), frozenset(SECOND_PERSON)


@dataclass
class Trees:
    learned: dict[str, float] = field(default_factory=dict)
    base: float = 0.0
    splits: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    """Per tree: feature and threshold of the inner nodes, level by level, and the leaves' values."""
    knots: np.ndarray = field(default_factory=lambda: np.zeros(0))
    heights: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for which, bound, leaf in self.splits:
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[np.arange(len(x)), which[node]] > bound[node])
            out += leaf[node - len(which)]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        m = self.margin(x)
        if not len(self.knots):
            return 1 / (1 + np.exp(-np.clip(m, -30, 30)))
        return np.clip(np.interp(m, self.knots, self.heights), 0, 1)


def boost(x: np.ndarray, y: np.ndarray) -> Trees:
    """Boosted trees of fixed depth on the logistic loss, splits from histograms."""
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c) for e, c in zip(edges, x.T, strict=True)], 1)
    rate = np.clip(y.mean(), 1e-4, 1 - 1e-4)
    model = Trees(base=float(np.log(rate / (1 - rate))))
    margin = np.full(len(y), model.base)
    inner = 2**DEPTH - 1
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        which, bound = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(len(y), np.int64)
        for level in range(DEPTH):
            first, width = 2**level - 1, 2**level
            gains, cuts = np.full((width, x.shape[1]), -np.inf), np.zeros((width, x.shape[1]), np.int64)
            for f in range(x.shape[1]):
                slot = (node - first) * BINS + binned[:, f]
                gs = np.bincount(slot, g, width * BINS).reshape(width, BINS).cumsum(1)
                hs = np.bincount(slot, h, width * BINS).reshape(width, BINS).cumsum(1)
                gl, hl, gt, ht = gs[:, :-1], hs[:, :-1], gs[:, -1:], hs[:, -1:]
                gain = np.where((hl > 1) & (ht - hl > 1), gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1), -np.inf)
                gain[:, len(edges[f]) :] = -np.inf
                cuts[:, f], gains[:, f] = gain.argmax(1), gain.max(1)
            best = gains.argmax(1)
            for k in range(width):
                if gains[k, best[k]] > 1e-6:
                    which[first + k], bound[first + k] = best[k], edges[best[k]][cuts[k, best[k]]]
            node = 2 * node + 1 + (x[np.arange(len(x)), which[node]] > bound[node])
        leaf = node - inner
        gl, hl = np.bincount(leaf, g, inner + 1), np.bincount(leaf, h, inner + 1)
        value = RATE * gl / (hl + 1)
        margin += value[leaf]
        model.splits.append((which, bound, value))
    return model


def isotonic(m: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots and heights of the non-decreasing fit of y on m; one count of each label is added at
    the ends, so that no height is quite 0 or 1."""
    order = np.argsort(m, kind="stable")
    m, y = np.concatenate([[m.min()], m[order], [m.max()]]), np.concatenate([[0.0], y[order], [1.0]])
    blocks: list[list[float]] = []
    for at, value in zip(m, y, strict=True):
        blocks.append([value, 1.0, at, at])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            s, n, _, hi = blocks.pop()
            blocks[-1][0] += s
            blocks[-1][1] += n
            blocks[-1][3] = hi
    knots, heights = [], []
    for s, n, lo, hi in blocks:
        knots += [lo, hi]
        heights += [s / n, s / n]
    return np.array(knots), np.array(heights)


def _distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 4 << 20):
        counts: Counter = Counter()
        for text, label in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            counts.update((s, label) for s in {s for w in set(WORD.findall((text or "").lower())) for s in stems(w)})
        words = list(counts)
        columns = [pa.array([w for w, _ in words], pa.string()), pa.array([k for _, k in words], pa.int32()), pa.array([counts[w] for w in words], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["word", "label", "n"])


def _featured(learned: dict[str, float]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(learned)
        for batch in slices(batches, 4 << 20):
            rows = [features(t, lexicon) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "label", "teaches", "x"])

    return run


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees:
    """Trees fitted on at most `sample` of the rows whose label may be learned from."""
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("label")).where("label in (0, 1)").where(~held_out(F.col("doc_id"), 3, 1) & F.col("doc_id").isNotNull())
    rows = materialise(sampled(docs, known, sample, 1 << 62).withColumn("teaches", F.pmod(F.xxhash64("text", F.lit("split")), F.lit(4)) > 0))
    split = {(r.teaches, r.label): r["count"] for r in rows.groupBy("teaches", "label").count().collect()}
    if len({label for _, label in split}) < 2:
        return Trees(base=30.0 if any(label for _, label in split) else -30.0)
    apart = len(split) == 4  # else there are too few rows to calibrate on rows of their own
    taught = rows.where("teaches") if apart else rows
    total = {label: sum(n for (t, k), n in split.items() if k == label and (t or not apart)) for label in (0, 1)}
    counted = taught.mapInArrow(_distinct_words, "word string, label int, n long").groupBy("word").agg(
        F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("toxic"), F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("clean")
    )
    weight = F.log((F.col("toxic") + 0.5) / (total[1] + 1)) - F.log((F.col("clean") + 0.5) / (total[0] + 1))
    told = counted.where(F.col("toxic") >= LEAST_DOCS).select("word", weight.alias("weight"), (weight * F.col("toxic")).alias("gain")).where("weight > 2.0")
    learned = {r.word: r.weight for r in told.orderBy(F.desc("gain"), "word").limit(LEARNED).collect()}
    featured = rows.select("doc_id", "text", "label", "teaches").mapInArrow(_featured(learned), "doc_id long, label int, teaches boolean, x array<double>")
    got = sorted((r.doc_id, r.label, r.teaches, tuple(r.x)) for r in featured.collect())
    x, y, part = np.array([r[3] for r in got]), np.array([float(r[1]) for r in got]), np.array([r[2] for r in got])
    model = boost(x[part], y[part]) if apart else boost(x, y)
    if apart:
        model.knots, model.heights = isotonic(model.margin(x[~part]), y[~part])
    model.learned = learned
    return model


def _scored(model: Trees) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(model.learned)
        for batch in slices(batches, 4 << 20):
            x = np.array([features(t, lexicon) for t in batch.column(1).to_pylist()]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], names=["doc_id", "score"])

    return run


def toxicity_scores(docs: DataFrame, model: Trees) -> DataFrame:
    """doc_id and the calibrated probability of label 1 of each row of `docs` (doc_id, text)."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scored(model), "doc_id long, score double")


def op4_toxicity_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    scored = toxicity_scores(docs, fit(docs, read_table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op4_toxicity_trees": op4_toxicity_trees}
ORACLES: dict[str, str] = {}
