"""Byte-level BPE encoding and decoding (operator 7).

A text is pre-tokenised by a pattern and each match is merged by ranks. Texts of up to `CHUNK` characters are encoded at
once. Longer ones are cut into chunks that overlap by `OVERLAP` characters and are dealt over the cluster:

1. each chunk is pre-tokenised by itself; only the boundaries within its overlaps go to its neighbours;
2. a chunk is joined to the next at the first place in their overlap where both have a pre-token boundary. Scanning goes
   from left to right and keeps no state at a boundary, so from there on the later chunk's boundaries are those of the
   whole text. A chunk's own end is no boundary to go by;
3. the pieces between those places are encoded, and a text's pieces are put together in order.

A text with two chunks that never agree (say, one word longer than the overlap) is pre-tokenised whole.
Decoding concatenates the raw bytes of the ids.

Defined results: null text counts as empty and gives no ids; repeated rows each get their row; a null doc_id stays null;
empty tables give empty results.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, read_table, shuffle_width, slices

CHUNK = 1 << 15
OVERLAP = 1 << 10
RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


@lru_cache(maxsize=4)
def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def boundaries(text: str, pattern: str) -> np.ndarray:
    """Where the pre-tokens of `text` begin."""
    return np.fromiter((m.start() for m in regex.compile(pattern).finditer(text)), np.int64)


def encode_pieces(tokenizer: tiktoken.Encoding, text: str, begins: np.ndarray) -> np.ndarray:
    """The ids of pre-tokens that begin at `begins`."""
    memo: dict[str, list[int]] = {}
    out: list[int] = []
    ends = [*begins[1:].tolist(), len(text)]
    for a, b in zip(begins.tolist(), ends, strict=True):
        token = text[a:b]
        if token not in memo:
            memo[token] = tokenizer.encode_ordinary(token)
        out += memo[token]
    return np.array(out, dtype="<u4")


def decode(tokenizer: tiktoken.Encoding, ids: np.ndarray) -> bytes:
    return tokenizer.decode_bytes(ids.tolist())


def _whole(path: str, pattern: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = encoding(path, pattern)
        for batch in slices(batches, 4 << 20):
            rows = []
            for text in batch.column(1).to_pylist():
                ids = np.array(tokenizer.encode_ordinary(text or ""), dtype="<u4")
                rows.append((len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(decode(tokenizer, ids)).hexdigest()))
            n, ids_sha, text_sha = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return run


EDGES = "row long, k long, n long, head binary, tail binary"


def _edges(pattern: str, step: int, overlap: int) -> Callable:
    """Of each chunk the boundaries near its ends, which are all that its neighbours need."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(3).to_pylist()
            begins = [boundaries(t, pattern) for t in texts]
            head = [b[b < overlap].astype("<u4").tobytes() for b in begins]
            tail = [b[b >= step].astype("<u4").tobytes() for b in begins]
            columns = [batch.column(0), batch.column(2), pa.array([len(t) for t in texts], pa.int64()), pa.array(head, pa.binary()), pa.array(tail, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "k", "n", "head", "tail"])

    return run


def meeting_place(tail: np.ndarray, text_length: int, head: np.ndarray, step: int) -> int:
    """First place, counted in the later chunk, where both chunks have a boundary; -1 if there is none.

    The first chunk's last boundary is left out: the token that runs into its end may be cut short.
    """
    both = np.intersect1d(tail[:-1] - step, head[head < text_length - step])
    return int(both[0]) if len(both) else -1


def _meetings(step: int) -> Callable:
    """From the ends of chunks, each with those of its neighbours: where its own piece begins and stops; -1 if they don't meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = lambda blob: np.frombuffer(blob, "<u4").astype(np.int64)
        for batch in batches:
            first, stop = [], []
            for r in batch.to_pylist():
                first.append(0 if r["tail_before"] is None else meeting_place(of(r["tail_before"]), r["n_before"], of(r["head"]), step))
                met = r["n"] if r["head_after"] is None else meeting_place(of(r["tail"]), r["n"], of(r["head_after"]), step)
                stop.append(met if r["head_after"] is None or met < 0 else met + step)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(first, pa.int64()), pa.array(stop, pa.int64())], names=["row", "k", "first", "stop"])

    return run


def _encode_chunks(path: str, pattern: str) -> Callable:
    """From chunks (row, doc_id, k, text, first, stop): the ids of each one's own piece, none where chunks didn't meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = encoding(path, pattern)
        for batch in batches:
            out = []
            for text, first, stop in zip(*(batch.column(k).to_pylist() for k in (3, 4, 5)), strict=True):
                if first < 0 or stop < 0:
                    out.append(None)
                    continue
                begins = boundaries(text, pattern)
                out.append(encode_pieces(tokenizer, text[:stop], begins[(begins >= first) & (begins < stop)]).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.binary())], names=["row", "doc_id", "k", "ids"])

    return run


def _gather(path: str, pattern: str) -> Callable:
    """From pieces sorted by row and place: one line per text; n_tokens is -1 where chunks didn't meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = encoding(path, pattern)
        row = doc = None
        count, ids_hash, text_hash = 0, hashlib.sha256(), hashlib.sha256()

        def line() -> pa.RecordBatch:
            fields = [row, doc, count, ids_hash.hexdigest(), text_hash.hexdigest()]
            kinds = [pa.int64()] * 3 + [pa.string()] * 2
            return pa.RecordBatch.from_arrays([pa.array([f], k) for f, k in zip(fields, kinds, strict=True)], names=["row", "doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

        for piece in (p for batch in batches for p in batch.to_pylist()):
            if piece["row"] != row:
                if row is not None:
                    yield line()
                row, doc, count, ids_hash, text_hash = piece["row"], piece["doc_id"], 0, hashlib.sha256(), hashlib.sha256()
            if piece["ids"] is None or count < 0:
                count = -1
                continue
            ids = np.frombuffer(piece["ids"], "<u4")
            count += len(ids)
            ids_hash.update(piece["ids"])
            text_hash.update(decode(tokenizer, ids))
        if row is not None:
            yield line()

    return run


def round_trip(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Per row of `docs` (doc_id, text): number of ids, digest of the ids, digest of the decoded bytes."""
    width = shuffle_width(docs.sparkSession)
    step = chunk - overlap
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    short = texts.where(F.length("text") <= chunk).mapInArrow(_whole(path, pattern), RESULT)
    # written once, so that a text keeps its number whatever is computed again
    long = materialise(texts.where(F.length("text") > chunk).withColumn("row", F.monotonically_increasing_id()))
    blocks = long.select("row", "doc_id", F.regexp_extract_all("text", F.lit(f"(?s).{{1,{step}}}"), F.lit(0)).alias("b"))
    overlapping = F.transform("b", lambda x, k: F.concat(x, F.coalesce(F.left(F.get("b", k + 1), F.lit(overlap)), F.lit(""))))
    # a last block that the chunk before holds whole is none of its own
    own = F.slice(overlapping, F.lit(1), F.size("b") - (F.length(F.element_at("b", -1)) <= overlap).cast("int"))
    cut = blocks.select("row", "doc_id", F.posexplode(own).alias("k", "text")).select("row", "doc_id", F.col("k").cast("long").alias("k"), "text").repartition(width, "row", "k")
    ends = cut.mapInArrow(_edges(pattern, step, overlap), EDGES)
    order = Window.partitionBy("row").orderBy("k")
    sides = ends.select("row", "k", "n", "head", "tail", F.lag("tail").over(order).alias("tail_before"), F.lag("n").over(order).alias("n_before"), F.lead("head").over(order).alias("head_after"))
    met = sides.mapInArrow(_meetings(step), "row long, k long, first long, stop long")
    pieces = cut.join(met, ["row", "k"]).select("row", "doc_id", "k", "text", "first", "stop").mapInArrow(_encode_chunks(path, pattern), "row long, doc_id long, k long, ids binary")
    lines = pieces.repartition(width, "row").sortWithinPartitions("row", "k").mapInArrow(_gather(path, pattern), f"row long, {RESULT}")
    apart = lines.where("n_tokens < 0").select("row")
    whole = long.join(apart, "row", "left_semi").select("doc_id", "text").mapInArrow(_whole(path, pattern), RESULT)
    return short.unionByName(lines.where("n_tokens >= 0").drop("row")).unionByName(whole)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


QUERIES = {"op7_bpe": op7_bpe}
ORACLES: dict[str, str] = {}
