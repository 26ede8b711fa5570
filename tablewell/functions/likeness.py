"""Edit distance and Jaro-Winkler similarity of many pairs of strings at once, over numpy arrays."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

CELLS = 1 << 22
"""Characters of one side that are compared at a time."""


def _points(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of each string in a row, filled up with 0, and the lengths."""
    lengths = np.array([len(s) for s in strings], np.int64)
    flat = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.zeros((len(strings), max(1, int(lengths.max(initial=0)))), np.uint32)
    out[np.arange(out.shape[1]) < lengths[:, None]] = flat
    return out, lengths


def _groups(a: list[str], b: list[str]) -> list[np.ndarray]:
    """Places of the pairs, in groups of like length whose arrays stay small."""
    longest = np.maximum([len(s) for s in a], [len(s) for s in b]) if a else np.zeros(0, np.int64)
    order = np.argsort(longest, kind="stable")
    out, at = [], 0
    while at < len(order):
        n = max(1, CELLS // max(1, int(longest[order[at]])))
        # the last of a group is its longest
        while n > 1 and n * int(longest[order[min(at + n, len(order)) - 1]]) > 2 * CELLS:
            n //= 2
        out.append(order[at : at + n])
        at += n
    return out


def edit_distances(a: list[str], b: list[str], most: int) -> np.ndarray:
    """The edit distance of each pair, where it is at most `most`; else `most` + 1. Only a band of 2 * most + 1 diagonals is filled."""
    out = np.zeros(len(a), np.int64)
    for group in _groups(a, b):
        x, n = _points([a[k] for k in group])
        y, m = _points([b[k] for k in group])
        y = np.pad(y, ((0, 0), (most + 1, most + 1)))
        width = 2 * most + 1
        # cell d of row i is the distance of the first i characters of x to the first i + d - most of y
        row = np.full((len(group), width + 2), most + 1, np.int64)
        row[:, most + 1 :][:, : most + 1] = np.arange(most + 1)
        diagonal = m - n + most
        fits = (diagonal >= 0) & (diagonal < width)
        found = np.where(fits & (n == 0), row[np.arange(len(group)), np.clip(diagonal, 0, width - 1) + 1], most + 1)
        for i in range(1, x.shape[1] + 1):
            before = row
            row = np.full_like(before, most + 1)
            for d in range(width):
                j = i + d - most
                if j < 0:
                    continue
                if j == 0:
                    row[:, d + 1] = min(i, most + 1)
                    continue
                if j + most >= y.shape[1]:
                    break
                same = x[:, i - 1] == y[:, j + most]
                best = np.minimum(before[:, d + 1] + ~same, np.minimum(before[:, d + 2], row[:, d]) + 1)
                row[:, d + 1] = np.minimum(best, most + 1)
            done = fits & (n == i)
            found[done] = row[done, diagonal[done] + 1]
        out[group] = np.where(found > most, most + 1, found)
    return out


def jaro_winklers(a: list[str], b: list[str]) -> np.ndarray:
    """Jaro similarity, raised by a common beginning of up to 4 letters where it is above 0.7, of each pair; 0 if one is empty."""
    out = np.zeros(len(a))
    for group in _groups(a, b):
        x, n = _points([a[k] for k in group])
        y, m = _points([b[k] for k in group])
        reach = np.maximum(0, np.maximum(n, m) // 2 - 1)
        places = np.arange(y.shape[1])
        used, own = np.zeros(y.shape, bool), np.zeros(x.shape, bool)
        rows = np.arange(len(group))
        inside = places < m[:, None]
        for i in range(x.shape[1]):
            fits = (y == x[:, i, None]) & ~used & inside & (np.abs(places - i) <= reach[:, None]) & (i < n)[:, None]
            first = fits.argmax(1)
            hit = fits[rows, first]
            used[rows[hit], first[hit]] = True
            own[:, i] = hit
        both = own.sum(1)
        front = lambda points, mark: np.take_along_axis(points, np.argsort(~mark, axis=1, kind="stable"), 1)
        k = min(x.shape[1], y.shape[1])
        differ = (front(x, own)[:, :k] != front(y, used)[:, :k]) & (np.arange(k) < both[:, None])
        swaps = differ.sum(1) // 2
        with np.errstate(divide="ignore", invalid="ignore"):
            jaro = np.where(both > 0, (both / n + both / m + (both - swaps) / both) / 3, 0.0)
        head = min(4, x.shape[1], y.shape[1])
        alike = (x[:, :head] == y[:, :head]) & (np.arange(head) < np.minimum(n, m)[:, None])
        beginning = np.cumprod(alike, axis=1).sum(1) if head else np.zeros(len(group))
        out[group] = np.where(jaro > 0.7, jaro + beginning * 0.1 * (1 - jaro), jaro)
    return out


def jaro_winkler_of(a: str | None, b: str | None) -> float | None:
    return None if a is None or b is None else float(jaro_winklers([a], [b])[0])


def pandas_jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    known = (a.notna() & b.notna()).to_numpy()
    out = np.full(len(a), math.nan)
    out[known] = jaro_winklers(a[known].tolist(), b[known].tolist())
    return pd.Series(out).where(pd.Series(known), None).astype("Float64")


def jaro_winkler(a: Column | str, b: Column | str) -> Column:
    return F.pandas_udf(pandas_jaro_winkler, T.DoubleType())(a, b)
