"""Similarities of vectors as column expressions and SQL functions; the offline embedder; nearest neighbours."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..session import fixed

DIMS = 256
_WORDS = re.compile(r"[a-z0-9]+")
_DOT = "aggregate(zip_with(a, b, (x, y) -> double(x) * double(y)), 0D, (s, v) -> s + v)"
_NORM = "sqrt(aggregate({0}, 0D, (s, v) -> s + double(v) * double(v)))"
_GAP = "aggregate(zip_with(a, b, (x, y) -> (double(x) - double(y)) * (double(x) - double(y))), 0D, (s, v) -> s + v)"
_COS = f"try_divide({_DOT}, {_NORM.format('a')} * {_NORM.format('b')})"
# Names and bodies of the similarity functions.
SIMILARITIES = {
    "array_cosine_similarity": _COS,
    "array_cosine_distance": f"1D - {_COS}",
    "array_distance": f"sqrt({_GAP})",
    "array_inner_product": _DOT,
    "array_negative_inner_product": f"-{_DOT}",
    "array_dot_product": _DOT,
    "array_negative_dot_product": f"-{_DOT}",
}


def register(spark: SparkSession) -> None:
    """The similarities as SQL functions of the session."""
    for name, body in SIMILARITIES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(a ARRAY<FLOAT>, b ARRAY<FLOAT>) RETURNS DOUBLE RETURN {body}")


def inner_product(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))


def cosine_similarity(a: Column, b: Column) -> Column:
    """NULL for a zero vector."""
    return F.try_divide(inner_product(a, b), norm(a) * norm(b))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, v: s + v))


def nearest(df: DataFrame, vector: str, query: list[float], row_id: str, k: int) -> DataFrame:
    """The k rows most like the query vector, ties by row id, with `score`; rows without a vector are left out."""
    q = F.array(*(F.lit(float(x)) for x in query))
    return df.where(F.col(vector).isNotNull()).withColumn("score", cosine_similarity(F.col(vector), q)).orderBy(F.desc_nulls_last("score"), row_id).limit(k)


def _slots(tokens: list[str]) -> np.ndarray:
    """FNV-1a, 32 bits, modulo the width, of many tokens at once: one step for each byte place."""
    raw = [t.encode() for t in tokens]
    size = np.array([len(b) for b in raw], np.int64)
    text, start = np.frombuffer(b"".join(raw), np.uint8), np.cumsum(size) - size
    h = np.full(len(raw), 0x811C9DC5, np.uint32)
    for k in range(int(size.max(initial=0))):
        live = np.flatnonzero(size > k)
        h[live] = (h[live] ^ text[start[live] + k]) * np.uint32(0x01000193)
    return h % np.uint32(DIMS)


def _vectors_of(texts: list[str | None]) -> list[np.ndarray]:
    """Words and adjacent pairs of words counted in hashed slots, to length one; zeros without words. Each distinct token of
    the texts is hashed once."""
    place: dict[str, int] = {}
    held = []
    for text in texts:
        words = _WORDS.findall((text or "").lower())
        tokens = [*words, *map(" ".join, zip(words, words[1:], strict=False))]
        held.append([place.setdefault(t, len(place)) for t in tokens])
    slots = _slots(list(place))
    out = []
    for tokens in held:
        v = np.bincount(slots[tokens], minlength=DIMS).astype(float) if tokens else np.zeros(DIMS)
        out.append(v / math.sqrt(v @ v) if tokens else v)
    return out


def hash_embedding_of(text: str | None) -> list[float]:
    """The vector of one text."""
    return _vectors_of([text])[0].tolist()


TEXTS_CHARS, TEXTS = 1 << 20, 256


def _few_at_once(texts: list[str | None]) -> Iterator[list[str | None]]:
    """The texts in runs of at most `TEXTS` and of about `TEXTS_CHARS` characters, or one text."""
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and to - at < TEXTS and (to == at or size + len(texts[to] or "") <= TEXTS_CHARS):
            size += len(texts[to] or "")
            to += 1
        yield texts[at:to]
        at = to


def _hash_embeddings(kind: pa.DataType) -> Callable[[pa.Array], pa.Array]:
    """Vectors of a few texts at a time; what is held for a batch is its texts and its vectors end to end."""
    numbers = kind.to_pandas_dtype()

    def run(texts: pa.Array) -> pa.Array:
        out, at = np.empty((len(texts), DIMS), numbers), 0
        for own in _few_at_once_of(texts):
            out[at : at + len(own)] = _vectors_of(own)
            at += len(own)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * DIMS, pa.int32()), pa.array(out.ravel(), kind))

    return run


def _few_at_once_of(texts: pa.Array) -> Iterator[list[str | None]]:
    for at in range(0, len(texts), TEXTS):
        yield from _few_at_once(texts.slice(at, TEXTS).to_pylist())


def hash_embedding(text: Column | str, exact: bool = False) -> Column:
    """The vector as floats, or as doubles with `exact`."""
    run = _hash_embeddings(pa.float64() if exact else pa.float32())

    def embedded(texts: pa.Array) -> pa.Array:
        return run(texts)

    return F.arrow_udf(embedded, T.ArrayType(T.DoubleType() if exact else T.FloatType()))(text)


def missing_vectors(rows: DataFrame, vectors: DataFrame, row_id: str, columns: list[str]) -> DataFrame:
    """(row id, column, text) of non-blank texts that have no vector yet."""
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("text")) for c in columns)))
    queue = rows.select(row_id, each.alias("e")).select(row_id, "e.column", "e.text").where("trim(text) <> ''")
    return queue.join(vectors.select(row_id, "column"), [row_id, "column"], "left_anti")


BLOCK_BYTES = 4 << 20
HELD_BYTES = 64 << 20
TILE = 512
"""Queries, and rows, of a product that is made at once."""


def _blocks(df: DataFrame, row_id: str, vector: str, dims: int) -> DataFrame:
    """(ids, vectors) of many rows each: vectors of length one, end to end. Nulls, zeros and vectors of another length are left out."""
    kind = df.schema[row_id].dataType

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        per_block = max(1, BLOCK_BYTES // (8 * dims))
        for batch in batches:
            column = batch.column(1)
            fit = pc.fill_null(pc.equal(pc.list_value_length(column), dims), False)
            ids, kept = batch.column(0).filter(fit), column.filter(fit)
            flat = kept.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
            with np.errstate(invalid="ignore", divide="ignore"):
                unit = flat / np.sqrt((flat * flat).sum(1))[:, None]
            good = np.isfinite(unit).all(1)
            ids, unit = ids.filter(pa.array(good)), unit[good]
            for at in range(0, len(unit), per_block):
                own = ids.slice(at, per_block)
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays([0, len(own)], own), pa.array([unit[at : at + per_block].tobytes()], pa.binary())], names=["ids", "vectors"])

    return df.select(row_id, vector).where(F.col(row_id).isNotNull()).mapInArrow(pack, f"ids array<{kind.simpleString()}>, vectors binary")


def nearest_of_many(df: DataFrame, vector: str, row_id: str, queries: DataFrame, query_vector: str, query_id: str, k: int, dims: int) -> DataFrame:
    """(query, row, score, rank): the k rows most like each query's vector, by cosine similarity to 9 places, ties by row id.

    Rows and queries are packed into blocks. Every block of rows meets every block of queries in one matrix product, and a
    task keeps the k best rows of each query that it has seen, so what leaves it doesn't grow with its rows. Spark broadcasts
    the blocks of queries if they are small, and else shuffles the blocks of both.
    """
    rows = _blocks(df, row_id, vector, dims)
    asked = _blocks(queries, query_id, query_vector, dims).select(F.col("ids").alias("query_ids"), F.col("vectors").alias("query_vectors"))
    asked = asked.withColumn("block", F.monotonically_increasing_id()).transform(fixed)
    names = asked.agg(F.collect_list("block").alias("blocks"))  # a number for each block of queries, one row
    met = rows.join(names).select("ids", "vectors", F.explode("blocks").alias("block")).join(asked, "block")
    id_kind, query_kind = (f.schema[c].dataType.simpleString() for f, c in ((df, row_id), (queries, query_id)))
    kinds = to_arrow_type(queries.schema[query_id].dataType), to_arrow_type(df.schema[row_id].dataType)
    best = met.select("block", "ids", "vectors", "query_ids", "query_vectors").mapInArrow(_best(k, dims, kinds), f"query {query_kind}, row {id_kind}, score double")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "row")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _best(k: int, dims: int, kinds: tuple[pa.DataType, pa.DataType]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[list, np.ndarray, np.ndarray]]] = {}
        size = 0

        def flushed() -> Iterator[pa.RecordBatch]:
            for asked, scores, ids in (tile for tiles in held.values() for tile in tiles):
                queries = [q for q in asked for _ in range(scores.shape[1])]
                yield pa.RecordBatch.from_arrays([pa.array(queries, kinds[0]), pa.array(ids.ravel().tolist(), kinds[1]), pa.array(scores.ravel(), pa.float64())], names=["query", "row", "score"])

        def kept(own: list, scores: np.ndarray, rows: np.ndarray, score: np.ndarray, ids: np.ndarray) -> tuple[list, np.ndarray, np.ndarray]:
            # of the new rows only those that reach a query's k-th best score can matter, ties with it included
            if score.shape[1] > k:
                floor = np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k]
                if scores.shape[1] == k:
                    floor = np.maximum(floor, scores[:, -1])
                use = np.flatnonzero((score >= floor[:, None]).any(0))
                score, ids = score[:, use], ids[use]
            scores = np.concatenate([scores, score], 1)
            rows = np.concatenate([rows, np.broadcast_to(ids, score.shape)], 1)
            by_id = np.argsort(rows, axis=1, kind="stable")
            scores, rows = np.take_along_axis(scores, by_id, 1), np.take_along_axis(rows, by_id, 1)
            first = np.argsort(-scores, axis=1, kind="stable")[:, :k]
            return own, np.take_along_axis(scores, first, 1), np.take_along_axis(rows, first, 1)

        for batch in batches:
            for n in range(batch.num_rows):
                block, ids, vectors, asked, wanted = (c[n] for c in batch.columns)
                ids = np.array(ids.as_py(), object)
                theirs = np.frombuffer(vectors.as_buffer(), np.float64).reshape(-1, dims)
                mine = np.frombuffer(wanted.as_buffer(), np.float64).reshape(-1, dims)
                if block.as_py() not in held:
                    own = asked.as_py()
                    held[block.as_py()] = [(own[at : at + TILE], np.full((len(own[at : at + TILE]), 0), -np.inf), np.empty((len(own[at : at + TILE]), 0), object)) for at in range(0, len(own), TILE)]
                    size += 64 * k * len(own)
                # a product of two whole blocks has millions of figures, so it is made and used in tiles
                tiles = held[block.as_py()]
                for t, tile in enumerate(tiles):
                    for at in range(0, len(ids), TILE):
                        score = np.round(mine[t * TILE : (t + 1) * TILE] @ theirs[at : at + TILE].T, 9)
                        tile = kept(*tile, score, ids[at : at + TILE])
                    tiles[t] = tile
                if size > HELD_BYTES:
                    yield from flushed()
                    held, size = {}, 0
        yield from flushed()

    return run
