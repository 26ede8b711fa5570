"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NULL_ID = np.iinfo(np.int64).max
"""Stands for a null doc_id where documents are ordered: nulls come last."""


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors reach, as the cluster names it; ValueError where it names none, because a folder of one
    machine would lose data."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return folder


def materialise(df: DataFrame) -> DataFrame:
    """Compute `df` once and cut its lineage, in the shared checkpoint folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def join_skewed(big: DataFrame, small: DataFrame, key: str, n: str) -> DataFrame:
    """`big` joined to `small`, which has a row for each key and, under `n`, the number of rows of `big` with it.

    Keys with over a thousandth of all rows, of which there are less than a thousand, are sent along, so that none of them
    goes to one task; the others are shuffled.
    """
    total = small.agg(F.sum(n)).first()[0] or 0
    hot = F.col(n) > total / 1000
    rest = small.columns
    some = F.broadcast(small.where(hot).drop(n))
    often = big.join(some, key)
    seldom = big.join(some.select(key), key, "left_anti").join(small.where(~hot).drop(n), key)
    names = [*big.columns, *(c for c in rest if c not in (key, n))]
    return often.select(*names).unionByName(seldom.select(*names))


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def squeeze(*columns: np.ndarray) -> bytes:
    """Columns of equal length as one compressed value; first bytes lie together, then second bytes, and so on."""
    planes = [np.array([len(columns[0])], dtype=np.int64).tobytes()]
    for c in columns:
        planes.append(np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.dtype.itemsize).T.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def unsqueeze(blob: bytes, *dtypes: str) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, at, out = int(np.frombuffer(raw, np.int64, 1)[0]), 8, []
    for kind in map(np.dtype, dtypes):
        planes = np.frombuffer(raw, np.uint8, n * kind.itemsize, at).reshape(kind.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).view(kind).reshape(n))
        at += n * kind.itemsize
    return out


def slices(batches: Iterator[pa.RecordBatch], most_bytes: int) -> Iterator[pa.RecordBatch]:
    """The rows of `batches` regrouped so that a group has about `most_bytes`, or one row."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            per_row = max(1, batch.nbytes // batch.num_rows)
            n = max(1, min(batch.num_rows - at, (most_bytes - size) // per_row))
            part = batch.slice(at, n)
            held.append(part)
            size += part.nbytes
            at += n
            if size >= most_bytes:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def as_table(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def free_name(taken: list[str], wanted: str) -> str:
    """`wanted`, lengthened until it's no column of the input (Spark compares names without case)."""
    lower = {c.lower() for c in taken}
    while wanted.lower() in lower:
        wanted += "_"
    return wanted


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, end to end, and where each value begins (nulls: empty)."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    starts = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[starts[0] : starts[-1]], starts - starts[0]


_SPACES = bytes(0x20 if b == 0x20 or 0x09 <= b <= 0x0D else b for b in range(256))
PIECE_BYTES = 4 << 20


def word_lists(raw: bytes, size: int = PIECE_BYTES) -> Iterator[list[bytes]]:
    """The maximal runs of bytes other than \\x20 and \\x09-\\x0D, in lists from pieces of about `size` bytes, so that a long text
    isn't held as one list of words; a text has at least one list."""
    if len(raw) <= size:
        yield raw.split()
        return
    raw = raw.translate(_SPACES)
    at = 0
    while at < len(raw):
        end = raw.find(b" ", at + size)
        end = len(raw) if end < 0 else end
        yield raw[at:end].split()
        at = end
