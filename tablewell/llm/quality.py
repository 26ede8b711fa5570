"""Quality classifier (operator 9): a byte-level convolutional network in numpy.

A text's UTF-8 bytes are cut into chunks of `CHUNK` that overlap by half and cover the whole of it. Learned filters of `TAPS`
bytes run over each chunk (bytes are embedded first; for scoring, embedding and filter are folded into one table per tap)
and are max-pooled over the chunk. The maximum and the mean over a text's chunks, per filter, go into one logistic unit,
which gives the probability of label 1.

Training takes at most `SAMPLE` labelled rows (one for each doc_id), those of least hash of doc_id, as long as their texts
have no more than `SAMPLE_BYTES` together; it sees every chunk of these, as scoring does of every text. It runs in the
driver, in steps that hold a few texts' pooled chunks only. The model is sent with the task.

Defined results: null and empty texts are one chunk of padding and get a score like any other; null doc_ids pass (their
labels are not learned from, and they count as not held out); without labels of both kinds every score is the prior, the
share of label 1, or 1.0 where there is no label at all; repeated rows each get their row; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, materialise, read_table, shuffle_width, slices, text_bytes

CHUNK = 256
TAPS = 6
WIDTH = 8
FILTERS = 16
SAMPLE = 3000
SAMPLE_BYTES = 64 << 20
EPOCHS = 8
STEP_TEXTS = 32
STEP_HALVES = 1024
THRESHOLD = 0.3


@dataclass
class Network:
    table: np.ndarray
    """[tap, byte or padding, filter]: embedding and filters folded together."""
    bias: np.ndarray
    weight: np.ndarray
    """Of the maximum of each filter, then of the mean."""
    offset: float


def chunk_starts(n: int) -> np.ndarray:
    """Chunks of a text of n bytes: they begin half a chunk apart and reach its end."""
    return np.arange(0, max(1, n - CHUNK // 2), CHUNK // 2)


def score_bytes(net: Network, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Probabilities of the texts that lie end to end in `data`."""
    half, filters = CHUNK // 2, net.bias.size
    out = np.empty(len(starts) - 1)
    room = np.empty((2, 16 * half, filters), np.float32)
    for k, (a, b) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)):
        n_half = max(1, -(-(b - a) // half))
        top = np.full(filters, -np.inf, np.float32)
        total = np.zeros(filters)
        before = None
        for lo in range(0, n_half, 16):
            hi = min(n_half, lo + 16)
            piece = np.full((hi - lo) * half + TAPS - 1, 256, np.int64)
            own = data[a + lo * half : min(b, a + hi * half + TAPS - 1)]
            piece[: len(own)] = own
            size = (hi - lo) * half
            act, more = room[0, :size], room[1, :size]
            np.take(net.table[0], piece[:size], axis=0, out=act, mode="clip")
            for t in range(1, TAPS):
                act += np.take(net.table[t], piece[t : t + size], axis=0, out=more, mode="clip")
            peaks = act.reshape(hi - lo, half, filters)
            for fold in (64, 32, 16, 8, 4, 2, 1):
                peaks = np.maximum(peaks[:, :fold], peaks[:, fold : 2 * fold])
            peaks = peaks[:, 0]
            if before is not None:
                peaks = np.concatenate([before, peaks])
            pooled = np.maximum(peaks[:-1], peaks[1:]) if len(peaks) > 1 else peaks if n_half == 1 else peaks[:0]
            before = peaks[-1:]
            if len(pooled):
                pooled = np.maximum(pooled + net.bias, 0)
                top = np.maximum(top, pooled.max(0))
                total += pooled.sum(0)
        mean = total / max(1, n_half - 1)
        z = float(np.concatenate([top, mean]) @ net.weight + net.offset)
        out[k] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    return out


def _pooled_halves(table: np.ndarray, data: np.ndarray, starts: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each half chunk of the texts: the greatest activation of each filter, the bytes that gave it [half, filter, tap],
    and whose it is; and the number of halves of each text."""
    half = CHUNK // 2
    sizes = starts[texts + 1] - starts[texts]
    many = np.maximum(1, -(-sizes // half))
    owner = np.repeat(np.arange(len(texts)), many)
    own = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
    first, left = starts[texts][owner] + own * half, sizes[owner] - own * half
    peaks, where = [], []
    span = np.arange(half + TAPS - 1)
    for lo in range(0, len(owner), STEP_HALVES):
        at = first[lo : lo + STEP_HALVES, None] + span
        inside = span < left[lo : lo + STEP_HALVES, None]
        x = np.full(at.shape, 256, np.int64)
        x[inside] = data[at[inside]]
        act = np.take(table[0], x[:, :half], axis=0)
        for t in range(1, TAPS):
            act += np.take(table[t], x[:, t : t + half], axis=0)
        best = act.argmax(1)
        peaks.append(np.take_along_axis(act, best[:, None], 1)[:, 0])
        where.append(x[np.arange(len(x))[:, None, None], best[:, :, None] + np.arange(TAPS)].astype(np.int16))
    return np.concatenate(peaks), np.concatenate(where), owner, many


def train(data: np.ndarray, starts: np.ndarray, labels: np.ndarray, seed: int = 7) -> Network:
    """Fit by Adam on the texts that lie end to end in `data`, with their labels; every chunk counts."""
    rng = np.random.default_rng(seed)
    p = {
        "e": rng.normal(0, 0.5, (257, WIDTH)),
        "f": rng.normal(0, (2 / (TAPS * WIDTH)) ** 0.5, (TAPS * WIDTH, FILTERS)),
        "b": np.zeros(FILTERS),
        "w": rng.normal(0, 0.2, 2 * FILTERS),
        "o": np.array([np.log((labels.mean() + 1e-3) / (1 - labels.mean() + 1e-3))]),
    }
    p = {k: v.astype(np.float32) for k, v in p.items()}
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    step = 0
    for epoch in range(EPOCHS):
        rate = 0.01 * (1 - epoch / EPOCHS) + 0.0005
        for texts in np.array_split(rng.permutation(len(labels)), max(1, len(labels) // STEP_TEXTS)):
            folded = np.stack([p["e"] @ p["f"][t * WIDTH : (t + 1) * WIDTH] for t in range(TAPS)])
            peaks, seen, owner, many = _pooled_halves(folded, data, starts, texts)
            # a chunk is two halves in a row, or a text's only one; it has the greater one's activation and bytes
            pair = np.flatnonzero(np.concatenate([owner[1:] == owner[:-1], [False]]))
            lone = np.flatnonzero(np.repeat(many == 1, many))
            one = np.sort(np.concatenate([pair, lone]))
            two = np.where(np.isin(one, lone), one, np.minimum(one + 1, len(owner) - 1))
            later = peaks[two] > peaks[one]
            raw = np.where(later, peaks[two], peaks[one]) + p["b"]
            bytes_ = np.where(later[:, :, None], seen[two], seen[one]).astype(np.int64)
            n = np.maximum(1, many - 1)
            first = np.cumsum(n) - n
            pooled = np.maximum(raw, 0)
            top = np.maximum.reduceat(pooled, first)
            mean = np.add.reduceat(pooled, first) / n[:, None]
            v = np.concatenate([top, mean], 1)
            score = 1 / (1 + np.exp(-np.clip(v @ p["w"] + p["o"], -30, 30)))
            slope = ((score - labels[texts]) / len(texts)).astype(np.float32)
            dv = slope[:, None] * p["w"]
            text_of = np.repeat(np.arange(len(texts)), n)
            is_top = pooled == top[text_of]
            shared = np.add.reduceat(is_top.astype(np.float32), first)
            dp = ((dv[:, :FILTERS] / shared)[text_of] * is_top + (dv[:, FILTERS:] / n[:, None])[text_of]) * (raw > 0)
            grads = {"w": v.T @ slope + 1e-4 * p["w"], "o": np.array([slope.sum()]), "b": dp.sum(0)}
            # how much each byte at each tap of each filter counts, then through embedding and filters
            cell = (np.arange(FILTERS)[:, None] * TAPS + np.arange(TAPS)) * 257 + bytes_
            weight = np.bincount(cell.ravel(), np.repeat(dp.ravel(), TAPS), FILTERS * TAPS * 257).reshape(FILTERS, TAPS, 257)
            filters = p["f"].reshape(TAPS, WIDTH, FILTERS)
            grads["f"] = np.einsum("ctb,bw->twc", weight, p["e"], optimize=True).reshape(TAPS * WIDTH, FILTERS)
            grads["e"] = np.einsum("ctb,twc->bw", weight, filters, optimize=True)
            step += 1
            for k, g in grads.items():
                m, s = moments[k]
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                p[k] -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    table = np.stack([p["e"] @ p["f"][t * WIDTH : (t + 1) * WIDTH] for t in range(TAPS)]).astype(np.float32)
    return Network(table, p["b"], p["w"].astype(np.float64), float(p["o"][0]))


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether a row's label must not be learned from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(modulus)) == remainder, F.lit(False))


def sampled(docs: DataFrame, known: DataFrame, sample: int, most_bytes: int) -> DataFrame:
    """doc_id, text and label of at most `sample` of the rows of `known` (doc_id, label), those of least hash of doc_id, whose
    texts have at most `most_bytes` together: in this order each text is taken that still fits. Of a doc_id with several texts it's the least one."""
    chosen = known.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    width = shuffle_width(docs.sparkSession)
    met = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").repartition(width, "doc_id")
    rows = materialise(met.groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"), F.first("label").alias("label")))
    # ids and sizes of at most `sample` rows; a text that no longer fits is left out by itself
    sizes = rows.select("doc_id", F.octet_length("text").cast("long").alias("size")).orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    total, taken = 0, []
    for r in sizes:
        if total + r["size"] <= most_bytes:
            total += r["size"]
            taken.append((r.doc_id,))
    fits = docs.sparkSession.createDataFrame(taken, rows.select("doc_id").schema)
    return rows.join(F.broadcast(fits), "doc_id").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "label")


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most_bytes: int = SAMPLE_BYTES) -> Network:
    """A network fitted on at most `sample` of the rows whose label may be learned from."""
    known = labels.select("doc_id", F.col("quality").cast("int").alias("label")).where("label in (0, 1)").where(~held_out(F.col("doc_id"), 5, 0) & F.col("doc_id").isNotNull())
    # both parameters bound what the driver gets
    got = sorted((r.doc_id, r.label, bytes(r.utf8)) for r in sampled(docs, known, sample, most_bytes).select("doc_id", "label", F.col("text").cast("binary").alias("utf8")).collect())
    y = np.array([r[1] for r in got], np.float32)
    if not len(y) or y.min() == y.max():
        prior = float(y.mean()) if len(y) else 1.0
        blank = Network(np.zeros((TAPS, 257, 1), np.float32), np.zeros(1, np.float32), np.zeros(2), 0.0)
        blank.offset = float(np.clip(np.log((prior + 1e-9) / (1 - prior + 1e-9)), -30, 30))
        return blank
    starts = np.concatenate([[0], np.cumsum([len(r[2]) for r in got])]).astype(np.int64)
    return train(np.frombuffer(b"".join(r[2] for r in got), np.uint8), starts, y)


def _scored(net: Network, text_at: int, name: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4 << 20):
            score = score_bytes(net, *text_bytes(batch.column(text_at)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], names=[*batch.schema.names, name])

    return run


def with_scores(docs: DataFrame, net: Network, name: str) -> DataFrame:
    """`docs` with the probability of label 1 of each text under `name`."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), f"`{name}` double"])
    return docs.mapInArrow(_scored(net, docs.columns.index("text"), name), schema)


def good_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """`docs`, all columns, without the rows that the classifier rejects."""
    name = free_name(docs.columns, "score__")
    return with_scores(docs, fit(docs, labels), name).where(F.col(name) >= threshold).drop(name)


def op9_quality_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = with_scores(docs, fit(docs, read_table(spark, sf_dir, "labels")), "score")
    return scored.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op9_quality_network": op9_quality_network}
ORACLES: dict[str, str] = {}
