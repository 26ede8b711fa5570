"""Similarity joins of strings: all pairs within an edit distance, or of a Jaro-Winkler similarity, without comparing all pairs.

Each distinct string gives a few keys such that any two strings that are alike share one. Keys are the rarest of its
pieces, where rarity is read from counts of hashed pieces, a table of a fixed size. Strings that share a key, and pass the
bounds on length and place, are compared; both bounds are exact, so no pair is lost. A key that very many strings have is
split over tasks.

Edit distance k: a change touches at most q pieces of q characters, so of the k * q + 1 rarest pieces of a string at least
one is in the other, within k places, and among its rarest too (pieces equal to the last one are kept with it). A string of
too few pieces for that, or that is short enough (`MOST_REMAINS`), is found through the strings that up to k deletions leave
of it, which it shares with all others that are within k, and with hardly any others. Keys are shuffled as hashes, once, and
strings of one key are compared where they meet, so what goes on are the pairs that are alike.

Jaro-Winkler similarity t, with l letters of common beginning: Jaro is at least (t - l / 10) / (1 - l / 10) = j, so lengths
are in proportion of at least 3 j - 2, and at least (3 j - 1) n m / (n + m) letters, a, are in both. Strings that agree in l
letters are searched by these letters together with the n - a + 1 rarest of the others.

Nulls are left out; the empty string is a string; repeated strings are one; an empty table has no pairs.
"""

from __future__ import annotations

import itertools
import math
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from ..functions.likeness import edit_distances, jaro_winklers
from ..session import fixed

SLOTS = 1 << 16
CROWD = 1000
"""Strings of one key that a task compares with the others of the key."""
MOST_REMAINS = 48
"""Strings of which up to so many are left by deletions are found through these alone: they are rarer than any piece."""
KEYED = "s string, n int, key long, place int"
MET = "key long, a string, n_a int, place_a int, b string, figure double"

Keys = Callable[[str, np.ndarray], Iterator[tuple[str, int]]]


def _slot(piece: str) -> int:
    return zlib.crc32(piece.encode("utf-8", "surrogatepass")) % SLOTS


def _sorted_by_rarity(pieces: list[tuple[str, int]], counts: np.ndarray) -> list[tuple[str, int]]:
    return sorted(pieces, key=lambda p: (counts[_slot(p[0])], p[0], p[1]))


def grams(s: str, q: int) -> list[tuple[str, int]]:
    """The pieces of q characters and their places; the ends are filled up, so that each end has pieces of its own."""
    padded = "\x02" * (q - 1) + s + "\x03" * (q - 1)
    return [(padded[k : k + q], k) for k in range(len(padded) - q + 1)]


def letters(s: str) -> list[tuple[str, int]]:
    """The letters, each with which occurrence it is."""
    seen: Counter[str] = Counter()
    out = []
    for k, c in enumerate(s):
        seen[c] += 1
        out.append((f"{c}{seen[c]}", k))
    return out


def _remains(s: str, k: int) -> set[str]:
    """What is left of a string after up to k deletions."""
    return {"".join(s[i] for i in range(len(s)) if i not in gone) for r in range(min(k, len(s)) + 1) for gone in itertools.combinations(range(len(s)), r)}


def edit_keys(most: int, q: int) -> Keys:
    few = most * q - q + 1
    """Strings of at most so many characters may have no piece left after `most` changes, or are as well found by deletions."""
    while most and sum(math.comb(few + 1, r) for r in range(most + 1)) <= MOST_REMAINS:
        few += 1

    def keys(s: str, counts: np.ndarray) -> Iterator[tuple[str, int]]:
        if len(s) <= few + most:
            yield from (("d" + rest, -1) for rest in _remains(s, most))
        if len(s) > few:
            pieces = _sorted_by_rarity(grams(s, q), counts)
            last = pieces[min(most * q, len(pieces) - 1)][0]
            for k, (piece, place) in enumerate(pieces):
                if k > most * q and piece != last:
                    break
                yield "g" + piece, place

    return keys


def _least_jaro(least: float, begin: int) -> float:
    return (least - 0.1 * begin) / (1 - 0.1 * begin)


def jaro_winkler_keys(least: float) -> Keys:
    def keys(s: str, counts: np.ndarray) -> Iterator[tuple[str, int]]:
        n = len(s)
        for begin in range(min(4, n) + 1):
            j = _least_jaro(least, begin) - 1e-9
            shortest = max(begin, 1, math.ceil((3 * j - 2) * n))
            common = math.ceil((3 * j - 1) * n * shortest / (n + shortest) - 1e-9) if n else 0
            head = f"{begin}{s[:begin]}"
            rest = _sorted_by_rarity(letters(s[begin:]), counts)
            if common <= begin:
                yield head, 0
            for piece, _ in rest[: n - common + 1]:
                yield f"{head}\x00{piece}", 0

    return keys


def _keyed(strings: DataFrame, pieces: Callable[[str], list[tuple[str, int]]], keys: Keys) -> DataFrame:
    """(s, n, key, place): the keys of each string."""

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for s in batch.column(0).to_pylist():
                for piece, _ in pieces(s):
                    counts[_slot(piece)] += 1
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["slot", "n"])

    counts = np.zeros(SLOTS, np.int64)
    for r in strings.mapInArrow(slots, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect():  # at most SLOTS rows
        counts[r.slot] = r.n

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_pylist()
            for at in range(0, len(own), 1000):
                rows = [(s, len(s), xxh64_intdigest(key.encode("utf-8", "surrogatepass")) - (1 << 63), place) for s in own[at : at + 1000] for key, place in sorted(set(keys(s, counts)))]
                columns = list(zip(*rows, strict=True)) or [()] * 4  # an empty string has no letters
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int32(), pa.int64(), pa.int32()), strict=True)], names=["s", "n", "key", "place"])

    return strings.mapInArrow(emit, KEYED)


Compare = Callable[[list[str], list[str]], np.ndarray]
Bound = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]
PAIRS_AT_ONCE = 1 << 17


def _alike(a: np.ndarray, b: np.ndarray, compare: Compare, good: Callable[[np.ndarray], np.ndarray]) -> pa.RecordBatch:
    """The pairs of strings that are alike, the lesser first, as rows of `MET`."""
    swap = a > b
    a, b = np.where(swap, b, a), np.where(swap, a, b)
    figure = np.asarray(compare(a.tolist(), b.tolist()), np.float64)
    some = np.flatnonzero(good(figure))
    none = lambda kind: pa.nulls(len(some), kind)
    return pa.RecordBatch.from_arrays([none(pa.int64()), pa.array(a[some], pa.string()), none(pa.int32()), none(pa.int32()), pa.array(b[some], pa.string()), pa.array(figure[some])], names=["key", "a", "n_a", "place_a", "b", "figure"])


def _meet(bound: Bound, compare: Compare, good: Callable[[np.ndarray], np.ndarray]) -> Callable:
    """From (s, n, key, place) sorted by key: the alike pairs of each key; a key of over `CROWD` rows passes as its rows (no b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple[np.ndarray, np.ndarray]] = []
        many = 0

        def flushed() -> Iterator[pa.RecordBatch]:
            if waiting:
                yield _alike(np.concatenate([w[0] for w in waiting]), np.concatenate([w[1] for w in waiting]), compare, good)

        def passed(key: int, s: np.ndarray, n: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(s), key)), pa.array(s, pa.string()), pa.array(n, pa.int32()), pa.array(place, pa.int32()), pa.nulls(len(s), pa.string()), pa.nulls(len(s), pa.float64())], names=["key", "a", "n_a", "place_a", "b", "figure"])

        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size, name, crowded = 0, None, False

        def closed() -> Iterator[pa.RecordBatch]:
            nonlocal many, waiting
            if crowded or size < 2:
                return
            s, n, place = (np.concatenate(x) for x in zip(*held, strict=True))
            for first in range(0, len(s), 256):
                i, j = np.nonzero(np.arange(first, min(len(s), first + 256))[:, None] < np.arange(len(s))[None, :])
                i += first
                met = bound(n[i], n[j], place[i], place[j]) & (s[i] != s[j])
                if met.any():
                    waiting.append((s[i[met]], s[j[met]]))
                    many += int(met.sum())
                if many >= PAIRS_AT_ONCE:
                    yield from flushed()
                    waiting, many = [], 0

        for batch in batches:
            if not batch.num_rows:
                continue
            s, n, key, place = batch.column(0).to_numpy(zero_copy_only=False), *(batch.column(k).to_numpy() for k in (1, 2, 3))
            cuts = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
            single = (np.diff(cuts) == 1) & (np.arange(len(cuts) - 1) > 0) & (np.arange(len(cuts) - 1) < len(cuts) - 2)  # whole keys of one string
            for lo, hi in zip(cuts[:-1][~single].tolist(), cuts[1:][~single].tolist(), strict=True):
                if key[lo] != name:
                    yield from closed()
                    held, size, name, crowded = [], 0, key[lo], False
                held.append((s[lo:hi], n[lo:hi], place[lo:hi]))
                size += hi - lo
                if size > CROWD:
                    for h in held:
                        yield passed(name, *h)
                    held, crowded = [], True
        yield from closed()
        yield from flushed()

    return run


def _candidates(keyed: DataFrame, bound: str) -> DataFrame:
    """(a, b) with a < b of the strings that share a key and pass the bound on lengths and places.

    Of a key with more than `CROWD` strings each task takes some of them, to compare with all of the key.
    """
    sizes = keyed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    spread = keyed.join(sizes, "key").withColumn("shares", F.ceil(F.col("size") / CROWD).cast("int"))
    one = spread.select("key", F.pmod(F.hash("s"), F.col("shares")).alias("share"), F.col("s").alias("a"), F.col("n").alias("n_a"), F.col("place").alias("place_a"))
    other = spread.select("key", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.col("s").alias("b"), F.col("n").alias("n_b"), F.col("place").alias("place_b"))
    met = one.join(other, ["key", "share"]).where("a < b").where(bound)
    return met.select("a", "b").distinct()


def _pairs(keyed: DataFrame, bound: Bound, sql_bound: str, compare: Compare, good: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(a, b, figure) with a < b of the alike strings that share a key and pass the bound on lengths and places: those of most
    keys come from the task that holds the key, those of crowded keys from a join."""

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _alike(*(batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)), compare, good)

    width = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = fixed(keyed.repartition(width, "key").sortWithinPartitions("key").mapInArrow(_meet(bound, compare, good), MET))
    crowd = met.where("b IS NULL").select(F.col("a").alias("s"), F.col("n_a").alias("n"), "key", F.col("place_a").alias("place"))
    both = met.where("b IS NOT NULL").unionByName(_candidates(crowd, sql_bound).mapInArrow(compared, MET))
    return both.select("a", "b", "figure").distinct()


def _strings(df: DataFrame, column: str) -> DataFrame:
    return fixed(df.select(F.col(column).alias("s")).where("s IS NOT NULL").distinct())


def edit_pairs(df: DataFrame, column: str, most: int, q: int | None = None) -> DataFrame:
    """(a, b, distance): the pairs a < b of distinct strings of a column whose edit distance is at most `most`.

    Longer pieces (`q` characters) are rarer, so fewer pairs are compared; shorter ones leave fewer strings to deletions.
    """
    q = q or max(2, 5 - most)
    keyed = _keyed(_strings(df, column), partial(grams, q=q), edit_keys(most, q))
    bound = lambda n_a, n_b, place_a, place_b: (abs(n_a - n_b) <= most) & ((place_a < 0) | (place_b < 0) | (abs(place_a - place_b) <= most))
    sql_bound = f"abs(n_a - n_b) <= {most} AND (place_a < 0 OR place_b < 0 OR abs(place_a - place_b) <= {most})"
    found = _pairs(keyed, bound, sql_bound, partial(edit_distances, most=most), lambda d: d <= most)
    return found.select("a", "b", F.col("figure").cast("int").alias("distance"))


def jaro_winkler_pairs(df: DataFrame, column: str, least: float) -> DataFrame:
    """(a, b, likeness): the pairs a < b of distinct strings of a column whose Jaro-Winkler similarity is at least `least`."""
    if not 0.7 < least <= 1:
        raise ValueError("the least similarity is over 0.7, below which common beginnings don't count, and at most 1")
    keyed = _keyed(_strings(df, column), letters, jaro_winkler_keys(least))
    ratio = 3 * _least_jaro(least, 4) - 2 - 1e-9
    bound = lambda n_a, n_b, place_a, place_b: np.minimum(n_a, n_b) >= ratio * np.maximum(n_a, n_b)
    found = _pairs(keyed, bound, f"least(n_a, n_b) >= {ratio} * greatest(n_a, n_b)", jaro_winklers, lambda x: x >= least)
    return found.select("a", "b", F.col("figure").alias("likeness"))
