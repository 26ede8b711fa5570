"""Suffix-array dedup (operator 8): remove repeated byte strings across documents.

Rule: a byte goes if a string of `WINDOW` bytes that covers it also starts in a document with a smaller doc_id.
Matches never cross documents and are judged on the input.

How it works, all of it as Spark shuffles of packed suffix arrays:

1. Documents are packed into batches of a few MB. Of each batch's suffixes, those are sampled whose 16-byte prefix has the
   least hash among all prefixes inside a window; any two equal windows sample the same suffix. Batches first tell which
   prefixes they sample, by marks of 32 bits, and hear which of them another document samples too (a mark shared by chance
   does no harm). The sampled suffixes of these, in the order of their bytes and with their neighbourhood (the text of all
   windows that sampled them), form the batch's suffix array. It is dealt out by prefix to as many shares as there are
   batches, so a share doesn't grow with the data.
2. In each share a logarithmic index family takes one batch's array after the other. Levels of equal size are merged:
   both are in order, so places come from searching one in the other. Entries whose neighbourhoods are equal, byte by
   byte, keep those of their smallest doc_id; the others are repeats over their whole neighbourhood.
3. Where one prefix is left with different neighbourhoods and documents, a match ends: their 50-byte strings are sorted, a
   few prefixes at a time, and equal ones compared byte by byte.
   A prefix with over `HOT` entries in one batch, or `HOTTEST` in its share, is hot: its entries' strings are dealt out one
   by one by their own 128-bit hash, so that it spreads over all tasks. A batch tells the prefix's share so, and its own
   entries of a prefix hot there skip step 2. The bytes of each string travel along, once for all places that a packet
   has of it, so hot strings are compared byte by byte too.
4. The matched windows go back to their batch, which cuts them out.

`SuffixFamily` keeps levels of all sampled suffixes in a folder, for batches that come later. Each `add` scans the new arrays against all levels
and merges those levels into its own that are not over twice its size, so an entry is rewritten a logarithmic number of
times. Memory per task is a batch, or a share.

Defined results: null text counts as empty; a null doc_id is larger than any other; rows with equal doc_id never remove
each other's bytes; texts under `WINDOW` bytes stay whole; an empty table gives an empty result; further columns pass.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NULL_ID, as_table, materialise, read_table, slices, squeeze, text_bytes, unsqueeze

WINDOW = 50
PREFIX = 16
BATCH_BYTES = 8 << 20
BLOCK = 1 << 18
LONGEST_RUN = 200
HOT = 64
HOTTEST = 4096
CHUNK_WINDOWS = 1 << 18
STORED = -2
"""The batch of rows that come from a folder."""
ROWS = "part long, kind string, bid long, doc binary, body binary, text binary"
_ROWS = pa.schema([("part", pa.int64()), ("kind", pa.string()), ("bid", pa.int64()), ("doc", pa.binary()), ("body", pa.binary()), ("text", pa.binary())])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    return x


def _words(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on, as a number; `data` needs 8 bytes more than are asked for."""
    return np.ndarray((len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))


def _window_hash(data: np.ndarray, at: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[at : at + length] for each entry, by the positional sums of its 8-byte words."""
    words = _words(np.concatenate([data, np.zeros(8, np.uint8)]))
    total = _mix(length.astype(np.uint64) + np.uint64(77))
    steps = np.arange(0, int(length.max(initial=0)), 8)
    for k in steps:
        live = np.flatnonzero(length > k) if k >= WINDOW - 8 else slice(None)
        here, left = at[live] + k, length[live] - k
        here = np.where(left >= 8, here, here - (8 - left))
        total[live] = _mix(total[live] + words[here])
    return total


def sample_suffixes(data: np.ndarray, starts: np.ndarray, placed: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(prefix hash, first window, number of windows, where in the first window the suffix begins) of each sampled suffix of
    the texts in `data`; the last is left out (zeros) unless it's asked for."""
    out: list[tuple[np.ndarray, ...]] = []
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    reach = WINDOW - PREFIX + 1
    first = 0
    while first < len(starts) - 1:
        last = max(first + 1, int(np.searchsorted(starts, starts[first] + BLOCK, "right")) - 1)
        lo, hi = int(starts[first]), int(starts[last])
        if hi - lo >= WINDOW:
            words = _words(padded[lo : hi + 8])
            m = hi - lo - PREFIX + 1
            h = every = _mix(_mix(words[:m]) + words[8 : 8 + m])
            size = 1
            while size * 2 <= reach:
                h = np.minimum(h[: len(h) - size], h[size:])
                size *= 2
            h = np.minimum(h[: len(h) - (reach - size)], h[reach - size :])
            edge = np.empty(len(h), bool)
            edge[0] = True
            np.not_equal(h[1:], h[:-1], out=edge[1:])
            inner = starts[first : last + 1] - lo
            edge[inner[:-1][inner[:-1] < len(h)]] = True
            # windows that would cross the end of a text are no windows
            ends = inner[1:]
            stop = ends - WINDOW + 1
            stop = stop[(stop > 0) & (stop < len(h))]
            edge[stop] = True
            at = np.flatnonzero(edge)
            n = np.diff(np.append(at, len(h)))
            text = np.searchsorted(inner, at, "right") - 1
            good = at + WINDOW <= inner[text + 1]
            n = np.minimum(n, inner[text + 1] - WINDOW + 1 - at)
            at, n, key = at[good], n[good], h[at[good]]
            if len(n) and n.max() > LONGEST_RUN:
                pieces = -(-n // LONGEST_RUN)
                back = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                at2 = np.repeat(at, pieces) + back * LONGEST_RUN
                n = np.minimum(np.repeat(at + n, pieces) - at2, LONGEST_RUN)
                at, key = at2, np.repeat(key, pieces)
            inside = (every[at[:, None] + np.arange(reach)] == key[:, None]).argmax(1) if placed else np.zeros(len(at), np.int64)
            out.append((key, at + lo, n, inside))
        first = last
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))  # type: ignore[return-value]


def _spread(at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Every place of runs of n places."""
    return np.repeat(at - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def _leads(*columns: np.ndarray) -> np.ndarray:
    """Where a run of equal rows begins."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    change = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(np.concatenate([[True], change]))


def _same_bytes(text: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether text[a : a + n] is text[b : b + n]."""
    out = np.ones(len(a), bool)
    for lo in range(0, len(a), 16384):
        some = slice(lo, lo + 16384)
        if len(n[some]):
            differ = text[_spread(a[some], n[some])] != text[_spread(b[some], n[some])]
            out[some] = ~np.logical_or.reduceat(differ, np.cumsum(n[some]) - n[some])
    return out


def _prefixes(text: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 16 bytes at each place as two numbers that sort as the bytes do."""
    words = _words(np.concatenate([text, np.zeros(16, np.uint8)]))
    return words[at].byteswap(), words[at + 8].byteswap()


class Level:
    """A suffix array: entries in the order of their first 16 bytes, equal ones by digest and document."""

    FIELDS = ("k1", "k2", "check", "doc", "origin", "at", "n", "inside", "pos")

    def __init__(self, **columns: np.ndarray) -> None:
        self.columns = [columns[f] for f in self.FIELDS]

    def __getattr__(self, name: str) -> np.ndarray:
        if name in self.FIELDS:
            return self.columns[self.FIELDS.index(name)]
        raise AttributeError(name)

    def __len__(self) -> int:
        return len(self.columns[0])

    def take(self, rows: np.ndarray) -> Level:
        return Level(**{f: c[rows] for f, c in zip(self.FIELDS, self.columns, strict=True)})


class IndexFamily:
    """Levels of suffix arrays over one growing text; levels grow geometrically, so an entry is merged a logarithmic number of
    times. Of entries with equal bytes those with the smallest document stay, the others are told in `repeats`."""

    def __init__(self) -> None:
        self.levels: list[Level] = []
        self.repeats: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = np.zeros(0, np.uint8)
        self.length = 0

    def put_text(self, text: np.ndarray) -> int:
        """Room is doubled as it runs out, so a text that comes in many parts is copied a few times in all."""
        if self.length + len(text) > len(self.held):
            more = np.empty(max(self.length + len(text), 2 * self.length), np.uint8)
            more[: self.length] = self.text()
            self.held = more
        self.held[self.length : self.length + len(text)] = text
        self.length += len(text)
        return self.length - len(text)

    def text(self) -> np.ndarray:
        return self.held[: self.length]

    def _merge(self, a: Level, b: Level) -> Level:
        """Both are in the order of k1, so each entry's place is its own plus that in the other."""
        order = np.empty(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + np.searchsorted(b.k1, a.k1, "left")] = np.arange(len(a))
        order[np.arange(len(b)) + np.searchsorted(a.k1, b.k1, "right")] = len(a) + np.arange(len(b))
        both = Level(**{f: np.concatenate(x)[order] for f, x in zip(Level.FIELDS, zip(a.columns, b.columns, strict=True), strict=True)})
        return self.deduped(self.ordered(both))

    def ordered(self, level: Level) -> Level:
        """Entries whose first 8 bytes are equal put in order."""
        same = level.k1[1:] == level.k1[:-1]
        if not same.any():
            return level
        rows = np.flatnonzero(np.concatenate([[False], same]) | np.concatenate([same, [False]]))
        order = np.arange(len(level))
        order[rows] = rows[np.lexsort((level.doc[rows], level.check[rows], level.k2[rows], level.k1[rows]))]
        return level.take(order)

    def deduped(self, level: Level) -> Level:
        """Of entries in order, those with equal bytes reduced to those of the smallest document."""
        if not len(level):
            return level
        lead = _leads(level.k1, level.k2, level.check)
        first = np.repeat(lead, np.diff(np.append(lead, len(level))))
        late = np.flatnonzero(level.doc > level.doc[first])
        length = level.n[late].astype(np.int64) + WINDOW - 1
        alike = (level.n[late] == level.n[first[late]]) & (level.inside[late] == level.inside[first[late]])
        late, length = late[alike], length[alike]
        late = late[_same_bytes(self.text(), level.pos[late], level.pos[first[late]], length)]
        if not len(late):
            return level
        self.repeats.append((level.origin[late], level.at[late], level.n[late]))
        keep = np.ones(len(level), bool)
        keep[late] = False
        return level.take(np.flatnonzero(keep))

    def add(self, level: Level) -> None:
        """Take a level that is in order already."""
        self.levels.append(level)
        while len(self.levels) > 1 and len(self.levels[-2]) < 2 * len(self.levels[-1]):
            self.levels.append(self._merge(self.levels.pop(), self.levels.pop()))

    def whole(self) -> Level | None:
        while len(self.levels) > 1:
            self.levels.append(self._merge(self.levels.pop(), self.levels.pop()))
        return self.levels[0] if self.levels else None


def _row(part: int, kind: str, bid: int, doc: bytes | None, body: bytes, text: bytes | None = None) -> dict:
    return {"part": int(part), "kind": kind, "bid": int(bid), "doc": doc, "body": body, "text": text}


def _emit(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=_ROWS)


def _replies(kind: str, origin: np.ndarray, place: np.ndarray, windows: np.ndarray) -> Iterator[pa.RecordBatch]:
    order = np.argsort(origin, kind="stable")
    cut = np.flatnonzero(np.diff(origin[order])) + 1
    for rows in np.split(order, cut):
        if len(rows):
            yield _emit([_row(origin[rows[0]], kind, origin[rows[0]], None, squeeze(place[rows].astype(np.uint32), windows[rows].astype(np.uint8)))])


def _unpack(blob: bytes) -> pa.RecordBatch:
    with pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(blob)) as stream:
        return as_table(list(stream))


def _pack(most_bytes: int, number: int = 0) -> Callable:
    """Batches of documents, each as one compressed value with an id of its own and its size as its part; `number` tells apart
    calls for one family."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = (number << 44) + (TaskContext.get().partitionId() << 24)
        for k, batch in enumerate(slices(batches, most_bytes)):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema) as stream:
                stream.write_batch(batch)
            yield _emit([_row(batch.nbytes, "T", base + k, None, zstandard.ZstdCompressor(level=3).compress(sink.getvalue()))])

    return run


def _ids(batch: pa.RecordBatch, id_at: int) -> np.ndarray:
    return pc.fill_null(batch.column(id_at).cast(pa.int64()), NULL_ID).to_numpy(zero_copy_only=False).astype(np.int64)


def _array_row(part: int, kind: str, level: Level, text: np.ndarray) -> dict:
    """A level as one row; its entries' text is put end to end."""
    ids, which = np.unique(level.doc, return_inverse=True)
    origins, whose = np.unique(level.origin, return_inverse=True)
    body = squeeze(level.at.astype(np.uint32), which.astype(np.uint32), whose.astype(np.uint32), level.n.astype(np.uint8), level.inside.astype(np.uint8))
    own = [text[_spread(level.pos[k : k + 16384], level.n[k : k + 16384].astype(np.int64) + WINDOW - 1)] for k in range(0, len(level), 16384)]
    packed = zstandard.ZstdCompressor(level=1).compress(np.concatenate(own).tobytes())
    head = squeeze(origins)
    return _row(part, kind, len(level), squeeze(np.diff(ids, prepend=0)), body, len(head).to_bytes(4, "little") + head + packed)


def _array_of(row: dict, family: IndexFamily) -> Level:
    """The level of a row; its text goes to the family."""
    at, which, whose, n, inside = unsqueeze(row["body"], "u4", "u4", "u4", "u1", "u1")
    (gaps,) = unsqueeze(row["doc"], "i8")
    cut = 4 + int.from_bytes(row["text"][:4], "little")
    (origins,) = unsqueeze(row["text"][4:cut], "i8")
    text = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["text"][cut:]), np.uint8)
    length = n.astype(np.int64) + WINDOW - 1
    pos = np.cumsum(length) - length
    k1, k2 = _prefixes(text, pos + inside)
    check = _window_hash(text, pos, length)
    return Level(k1=k1, k2=k2, check=check, doc=np.cumsum(gaps)[which], origin=origins[whose], at=at.astype(np.int64), n=n, inside=inside, pos=pos + family.put_text(text))


def _mark(key: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The share of a prefix hash, and 32 other bits of it."""
    mixed = _mix(key)
    return (mixed % np.uint64(parts)).astype(np.int64), (mixed >> np.uint64(32)).astype(np.uint32)


def _sketches(parts: int, id_at: int, text_at: int) -> Callable:
    """Which prefixes each batch samples, by marks of 32 bits, and whether several of its documents do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for b in batches for r in b.to_pylist()):
            batch = _unpack(row["body"])
            data, starts = text_bytes(batch.column(text_at))
            key, at, _, _ = sample_suffixes(data, starts, placed=False)
            if not len(key):
                continue
            doc = _ids(batch, id_at)[np.searchsorted(starts, at, "right") - 1]
            part, mark = _mark(key, parts)
            order = np.lexsort((mark, part))
            part, mark, doc = part[order], mark[order], doc[order]
            lead = _leads(part, mark)
            several = np.maximum.reduceat(doc, lead) != np.minimum.reduceat(doc, lead)
            part, mark = part[lead], mark[lead]
            cuts = np.searchsorted(part, np.arange(parts + 1))
            for p in np.flatnonzero(np.diff(cuts)):
                own = slice(int(cuts[p]), int(cuts[p + 1]))
                yield _emit([_row(p, "S", row["bid"], None, squeeze(np.diff(mark[own], prepend=np.uint32(0)), several[own].astype(np.uint8)))])

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From the marks of one share or several: to each batch those that another document has too."""
    held: dict[int, list[tuple[int, np.ndarray, np.ndarray]]] = {}
    for row in (r for b in batches for r in b.to_pylist()):
        mark, several = unsqueeze(row["body"], "u4", "u1")
        held.setdefault(row["part"], []).append((row["bid"], np.cumsum(mark, dtype=np.uint32), several))
    for part, rows in held.items():
        every = np.concatenate([r[1] for r in rows])
        values, count = np.unique(every, return_counts=True)
        count[np.searchsorted(values, np.concatenate([r[1][r[2] > 0] for r in rows]))] = 2
        values = values[count > 1]
        for bid, mark, _ in rows:
            found = mark[np.isin(mark, values, assume_unique=True)]
            if len(found):
                yield _emit([_row(bid, "S", bid, None, squeeze(np.full(len(found), part, np.uint32), np.diff(found, prepend=np.uint32(0))))])


def _wanted(blobs: list[bytes]) -> np.ndarray:
    """Shares and marks as one number each, in order."""
    got = [unsqueeze(b, "u4", "u4") for b in blobs]
    return np.unique(np.concatenate([part.astype(np.uint64) << np.uint64(32) | np.cumsum(mark, dtype=np.uint32) for part, mark in got]))


def _arrays(parts: int, id_at: int, text_at: int, only_shared: bool = False) -> Callable:
    """Step 1: the suffix array of each batch, dealt out by prefix; with `only_shared` of the prefixes it was told of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bid, blob, replies in _by_batch(batches):
            if only_shared and "S" not in replies:
                continue
            batch = _unpack(blob)
            data, starts = text_bytes(batch.column(text_at))
            key, at, n, inside = sample_suffixes(data, starts)
            if only_shared:
                part, mark = _mark(key, parts)
                some = np.flatnonzero(np.isin(part.astype(np.uint64) << np.uint64(32) | mark, _wanted(replies["S"])))
                key, at, n, inside = key[some], at[some], n[some], inside[some]
            if not len(key):
                continue
            doc = _ids(batch, id_at)[np.searchsorted(starts, at, "right") - 1]
            k1, k2 = _prefixes(data, at + inside)
            part = _share(k1, k2, parts)
            check = _window_hash(data, at, n + WINDOW - 1)
            every = Level(k1=k1, k2=k2, check=check, doc=doc, origin=np.full(len(at), bid), at=at, n=n, inside=inside, pos=at)
            family = IndexFamily()
            family.put_text(data)
            level = family.deduped(every.take(np.lexsort((doc, check, k2, k1, part))))
            part = _share(level.k1, level.k2, parts)
            lead = _leads(level.k1, level.k2)
            size = np.diff(np.append(lead, len(level)))
            hot = np.repeat(size > HOT, size)
            if hot.any():
                first = lead[size > HOT]
                for p in np.unique(part[first]):
                    own = first[part[first] == p]
                    yield _emit([_row(p, "K", bid, None, squeeze(level.k1[own], level.k2[own]))])
                yield from _hot_windows(parts, data, level.take(np.flatnonzero(hot)))
                level, part = level.take(np.flatnonzero(~hot)), part[~hot]
            cuts = np.searchsorted(part, np.arange(parts + 1))
            for p in np.flatnonzero(np.diff(cuts)):
                yield _emit([_array_row(int(p), "A", level.take(np.arange(cuts[p], cuts[p + 1])), data)])
            for origin, place, many in family.repeats:
                yield from _replies("F", origin, place, many)

    return run


def _strings_at(text: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """The 50-byte string at each place, as rows of bytes."""
    return text[pos[:, None] + np.arange(WINDOW)]


def _string_runs(two: np.ndarray, one: np.ndarray, strings: Callable, *ties: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, number of the string of each row in it): equal strings together, by their digests, and within these by `ties`.

    `strings(rows)` gives the bytes of rows. Every row is compared with the first of its digest; where these differ, the rows
    of that digest are put in order by their bytes instead.
    """
    order = np.lexsort((*ties[::-1], one, two))
    lead = _leads(two[order], one[order])
    size = np.diff(np.append(lead, len(order)))
    group = np.repeat(np.arange(len(lead)), size)
    equal = np.ones(len(order), bool)
    for lo in range(0, len(order), CHUNK_WINDOWS):
        some = np.arange(lo, min(len(order), lo + CHUNK_WINDOWS))
        some = some[lead[group[some]] != some]
        equal[some] = (strings(order[some]) == strings(order[lead[group[some]]])).all(1)
    if equal.all():
        return order, group
    odd = np.flatnonzero(np.isin(group, group[~equal]))
    kind = np.zeros(len(order), np.int64)
    kind[odd] = np.unique(np.ascontiguousarray(strings(order[odd])).view(f"V{WINDOW}")[:, 0], return_inverse=True)[1]
    again = np.lexsort((np.arange(len(order)), kind, group))
    order, group, kind = order[again], group[again], kind[again]
    return order, np.repeat(np.arange(len(lead := _leads(group, kind))), np.diff(np.append(lead, len(order))))


def _string_rows(kind: str, part: int, bid: int, strings: Callable, string: np.ndarray, *columns: np.ndarray) -> dict:
    """Rows of hot strings in the order of their strings, the bytes of each string once."""
    new = np.zeros(len(string), np.uint8)
    new[lead := _leads(string)] = 1
    return _row(part, kind, bid, None, squeeze(*columns, new), squeeze(strings(lead).reshape(-1)))


def _string_rows_of(row: dict) -> tuple[list[np.ndarray], np.ndarray]:
    """(digests, document, place and batch of each row, with the number of its string; the strings)."""
    *columns, new = unsqueeze(row["body"], "u8", "u8", "i8", "u4", "i8", "u1")
    return [*columns, np.cumsum(new, dtype=np.int64) - 1], unsqueeze(row["text"], "u1")[0].reshape(-1, WINDOW)


def _hot_windows(parts: int, text: np.ndarray, level: Level) -> Iterator[pa.RecordBatch]:
    """The strings of hot prefixes, dealt out by their own hash; of equal ones those of the least document."""
    for lo in range(0, len(level), 4096):
        some = level.take(np.arange(lo, min(len(level), lo + 4096)))
        n = some.n.astype(np.int64)
        run = np.repeat(np.arange(len(n)), n)
        pos, place = _spread(some.pos, n), _spread(some.at.astype(np.int64), n)
        doc, origin = some.doc[run], some.origin[run]
        one = _window_hash(text, pos, np.full(len(pos), WINDOW))
        two = _mix(_window_hash(text, pos + 1, np.full(len(pos), WINDOW - 1)) ^ (text[pos].astype(np.uint64) + np.uint64(1)))
        order, string = _string_runs(two, one, lambda rows, pos=pos: _strings_at(text, pos[rows]), doc)
        one, two, doc, pos, place, origin = (x[order] for x in (one, two, doc, pos, place, origin))
        late = doc > doc[np.searchsorted(string, string)]
        if late.any():
            yield from _replies("F", origin[late], place[late], np.ones(int(late.sum()), np.uint8))
        one, two, doc, pos, place, origin, string = (x[~late] for x in (one, two, doc, pos, place, origin, string))
        part = (two % np.uint64(parts)).astype(np.int64)
        for p in np.unique(part):
            own = np.flatnonzero(part == p)
            columns = (two[own], one[own], doc[own], place[own].astype(np.uint32), origin[own])
            yield _emit([_string_rows("W", p, -1, lambda rows, at=pos[own]: _strings_at(text, at[rows]), string[own], *columns)])


def _ends(text: np.ndarray, level: Level, group: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Step 3: equal 50-byte strings among entries of one prefix each (`group`, ascending), a few prefixes at a time."""
    n = level.n.astype(np.int64)
    lead = _leads(group)
    total = np.cumsum(n)
    begin = 0
    while begin < len(lead):
        before = total[lead[begin]] - n[lead[begin]]
        stop = max(begin + 1, int(np.searchsorted(np.append(total[lead[1:] - 1], total[-1]), before + CHUNK_WINDOWS, "right")))
        rows = np.arange(lead[begin], lead[stop] if stop < len(lead) else len(level))
        begin = stop
        pos = _spread(level.pos[rows], n[rows])
        run = np.repeat(rows, n[rows])
        digest, doc = _window_hash(text, pos, np.full(len(pos), WINDOW)), level.doc[run]
        order = np.lexsort((doc, digest))
        digest, doc, pos, run = digest[order], doc[order], pos[order], run[order]
        place = level.at[run].astype(np.int64) + pos - level.pos[run]
        first = _leads(digest)
        winner = np.repeat(first, np.diff(np.append(first, len(digest))))
        late = np.flatnonzero(doc > doc[winner])
        equal = _same_bytes(text, pos[late], pos[winner[late]], np.full(len(late), WINDOW))
        if not equal.all():  # different strings of one digest: their run again, string by string
            odd = np.isin(winner, winner[late[~equal]])
            least: dict[bytes, int] = {}
            shown = {k: text[pos[k] : pos[k] + WINDOW].tobytes() for k in np.flatnonzero(odd).tolist()}
            for k, string in shown.items():
                least[string] = min(least.get(string, int(doc[k])), int(doc[k]))
            more = [k for k, string in shown.items() if doc[k] > least[string]]
            late = np.concatenate([late[~odd[late]], np.array(more, np.int64)])
        if len(late):
            yield from _replies("F", level.origin[run[late]], place[late], np.ones(len(late), np.uint8))


def _scan(parts: int, keep: bool = False) -> Callable:
    """Step 2: index families over shares of the prefixes; repeats go back to their batches, hot strings on to others.

    Rows of kind B are levels that stay as they are; with `keep`, all others come out as one level of kind L.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family, tokens, stay, part = IndexFamily(), [], [], None
        for row in (r for b in batches for r in b.to_pylist()):
            if row["kind"] in ("F", "W"):
                yield _emit([row])
                continue
            part = row["part"]
            if row["kind"] == "K":
                tokens.append(np.stack(unsqueeze(row["body"], "u8", "u8"), 1))
                if keep and row["bid"] != STORED:
                    yield _emit([row])
            elif row["kind"] == "B":
                stay.append(_array_of(row, family))
            else:
                family.add(_array_of(row, family))
        level = family.whole()
        if keep and level is not None and len(level):
            yield _emit([_array_row(part, "L", level, family.text())])
        for other in stay:
            family.add(other)
        level = family.whole()
        for origin, place, many in family.repeats:
            yield from _replies("F", origin, place, many)
        if level is None or not len(level):
            return
        text = family.text()
        lead = _leads(level.k1, level.k2)
        size = np.diff(np.append(lead, len(level)))
        mixed = np.maximum.reduceat(level.doc, lead) != np.minimum.reduceat(level.doc, lead)
        told = np.zeros(len(lead), bool)
        if tokens:
            pair = np.dtype([("a", "u8"), ("b", "u8")])
            known = np.unique(np.concatenate(tokens), axis=0)
            told = np.isin(np.stack([level.k1[lead], level.k2[lead]], 1).copy().view(pair)[:, 0], known.copy().view(pair)[:, 0])
        hot = told | (mixed & (size > HOTTEST))
        group = np.repeat(np.arange(len(lead)), size)
        some = np.flatnonzero(np.repeat(hot, size))
        if len(some):
            yield from _hot_windows(parts, text, level.take(some))
        some = np.flatnonzero(np.repeat(mixed & ~hot, size))
        if len(some):
            yield from _ends(text, level.take(some), group[some])

    return run


def _scan_hot(keep: bool = False) -> Callable:
    """Equal strings of hot prefixes, found by their hash and compared byte by byte; with `keep`, those of the least document
    come out too (kind V), unless they are stored already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got, shown, part, many = [], [], None, 0
        for row in (r for b in batches for r in b.to_pylist()):
            part = row["part"]
            (*columns, number), strings = _string_rows_of(row)
            got.append([*columns, np.full(len(number), row["bid"] != STORED), number + many])
            shown.append(strings)
            many += len(strings)
        if not got:
            return
        two, one, doc, place, origin, fresh, number = (np.concatenate(x) for x in zip(*got, strict=True))
        every = np.concatenate(shown)
        order, string = _string_runs(two, one, lambda rows: every[number[rows]], doc, origin, place, fresh)
        two, one, doc, place, origin, fresh, number = (x[order] for x in (two, one, doc, place, origin, fresh, number))
        late = doc > doc[np.searchsorted(string, string)]
        if late.any():
            yield from _replies("F", origin[late], place[late], np.ones(int(late.sum()), np.uint8))
        if keep:
            new = fresh & ~late
            new[np.setdiff1d(np.arange(len(new)), _leads(string, doc, origin, place))] = False
            if new.any():
                rows = (x[new] for x in (two, one, doc, place, origin))
                yield _emit([_string_rows("V", part, -1, lambda k, at=number[new]: every[at[k]], string[new], *rows)])

    return run


def _redealt(parts: int) -> Callable:
    """Stored levels and strings, dealt out again over `parts` shares."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for b in batches for r in b.to_pylist()):
            if row["kind"] == "V":
                (two, *rest, number), strings = _string_rows_of(row)
                part = (two % np.uint64(parts)).astype(np.int64)
                for p in np.unique(part):
                    own = part == p
                    yield _emit([_string_rows("W", p, STORED, lambda k, at=number[own]: strings[at[k]], number[own], two[own], *(x[own] for x in rest))])
                continue
            if row["kind"] == "K":
                k1, k2 = unsqueeze(row["body"], "u8", "u8")
                part = _share(k1, k2, parts)
                for p in np.unique(part):
                    yield _emit([_row(p, "K", STORED, None, squeeze(k1[part == p], k2[part == p]))])
                continue
            family = IndexFamily()
            level = _array_of(row, family)
            part = _share(level.k1, level.k2, parts)
            for p in np.unique(part):
                yield _emit([_array_row(p, row["kind"], level.take(np.flatnonzero(part == p)), family.text())])

    return run


def _share(k1: np.ndarray, k2: np.ndarray, parts: int) -> np.ndarray:
    """Which share a prefix belongs to."""
    return (_mix(_mix(_mix(k1.byteswap()) + k2.byteswap())) % np.uint64(parts)).astype(np.int64)


def _by_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bytes, dict[str, list[bytes]]]]:
    """Rows sorted by bid and kind, brought together: batch id, documents, replies by kind."""
    bid, replies, text = None, {}, None
    for batch in batches:
        for k in range(batch.num_rows):
            here, kind, body = batch.column(2)[k].as_py(), batch.column(1)[k].as_py(), batch.column(4)[k].as_py()
            if here != bid:
                if text is not None:
                    yield bid, text, replies
                bid, replies, text = here, {}, None
            if kind == "T":
                text = body
            else:
                replies.setdefault(kind, []).append(body)
    if text is not None:
        yield bid, text, replies


def _windows(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    got = [unsqueeze(b, "u4", "u1") for b in blobs]
    return np.concatenate([x[0] for x in got]).astype(np.int64), np.concatenate([x[1] for x in got]).astype(np.int64)


def _cut(id_at: int, text_at: int, finish: Callable) -> Callable:
    """Step 4: the bytes that matched windows cover leave their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, blob, replies in _by_batch(batches):
            batch = _unpack(blob)
            data, starts = text_bytes(batch.column(text_at))
            gone = np.zeros(len(data) + 1, np.int32)
            if "F" in replies:
                at, n = _windows(replies["F"])
                np.add.at(gone, at, 1)
                np.add.at(gone, at + n + WINDOW - 1, -1)
            yield finish(batch, data, starts, np.cumsum(gone[:-1]) > 0, id_at, text_at)

    return run


def _spans_of(gone: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per text: bytes removed, and maximal removed runs."""
    total = np.concatenate([[0], np.cumsum(gone)])
    first = gone.copy()
    first[1:] &= ~gone[:-1]
    own = starts[:-1][starts[:-1] < len(gone)]
    first[own] = gone[own]
    runs = np.concatenate([[0], np.cumsum(first)])
    return total[starts[1:]] - total[starts[:-1]], runs[starts[1:]] - runs[starts[:-1]]


def _digest(batch: pa.RecordBatch, data: np.ndarray, starts: np.ndarray, gone: np.ndarray, id_at: int, text_at: int) -> pa.RecordBatch:
    removed, runs = _spans_of(gone, starts)
    sha = [hashlib.sha256(data[a:b][~gone[a:b]].tobytes()).hexdigest() for a, b in zip(starts[:-1], starts[1:], strict=True)]
    columns = [batch.column(id_at).cast(pa.int64()), np.diff(starts), removed, runs]
    return pa.RecordBatch.from_arrays(
        [*(pa.array(c, pa.int64()) for c in columns), pa.array(sha, pa.string())],
        names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    )


def _kept_text(batch: pa.RecordBatch, data: np.ndarray, starts: np.ndarray, gone: np.ndarray, id_at: int, text_at: int) -> pa.RecordBatch:
    """Characters stay whole: one of which only some bytes are covered is kept."""
    follows = (data & 0xC0) == 0x80
    if follows.any():
        lead = np.flatnonzero(~follows)
        whole = np.logical_and.reduceat(gone, lead)
        gone = np.repeat(whole, np.diff(np.append(lead, len(data))))
    null = batch.column(text_at).is_null().to_pylist()
    text = [None if no else data[a:b][~gone[a:b]].tobytes().decode() for a, b, no in zip(starts[:-1], starts[1:], null, strict=True)]
    columns = [batch.column(k) if k != text_at else pa.array(text, batch.schema.field(k).type) for k in range(batch.num_columns)]
    return pa.RecordBatch.from_arrays(columns, schema=batch.schema)


def _dealt(rows: DataFrame, parts: int) -> DataFrame:
    """Each part in a task of its own."""
    return rows.repartitionById(parts, F.pmod("part", F.lit(parts)).cast("int"))


def _shares(texts: DataFrame, most_bytes: int) -> int:
    """As many as there are bytes for batches."""
    return 1 + (texts.agg(F.sum("part")).first()[0] or 0) // most_bytes


def _matched(texts: DataFrame, parts: int, id_at: int, text_at: int, stored: DataFrame | None = None, keep: bool = False) -> DataFrame:
    """Rows of kind F, the matched windows of the batches of `texts` and of those in `stored`; with `keep`, also what a family
    stores (kinds L, K and V). Without it, only prefixes that several documents sample go into the arrays."""
    if not keep:
        marks = materialise(_dealt(texts.mapInArrow(_sketches(parts, id_at, text_at), ROWS), parts).mapInArrow(_shared, ROWS))
        texts = texts.unionByName(marks).repartition(parts, "bid").sortWithinPartitions("bid", "kind")
    arrays = texts.mapInArrow(_arrays(parts, id_at, text_at, not keep), ROWS)
    if stored is not None:
        arrays = arrays.unionByName(stored.mapInArrow(_redealt(parts), ROWS))
    found = materialise(_dealt(arrays, parts).mapInArrow(_scan(parts, keep), ROWS))
    hot = _dealt(found.where("kind = 'W'"), parts).mapInArrow(_scan_hot(keep), ROWS)
    return found.where("kind <> 'W'").unionByName(hot)


def _cut_out(texts: DataFrame, matched: DataFrame, parts: int, id_at: int, text_at: int, finish: Callable, schema: object) -> DataFrame:
    together = texts.unionByName(matched).repartition(parts, "bid").sortWithinPartitions("bid", "kind")
    return together.mapInArrow(_cut(id_at, text_at, finish), schema)


def _run(docs: DataFrame, finish: Callable, schema: object, most_bytes: int = BATCH_BYTES) -> DataFrame:
    id_at, text_at = docs.columns.index("doc_id"), docs.columns.index("text")
    texts = materialise(docs.mapInArrow(_pack(most_bytes), ROWS))
    parts = _shares(texts, most_bytes)
    return _cut_out(texts, _matched(texts, parts, id_at, text_at), parts, id_at, text_at, finish, schema)


class SuffixFamily:
    """Suffix arrays of all documents added so far, as levels in a folder of Parquet files.

    An `add` is a folder of its own, named by its number, and counts once its last file is there; one that failed is done
    again under the same number.
    """

    def __init__(self, spark: SparkSession, folder: str, most_bytes: int = BATCH_BYTES) -> None:
        self.spark, self.folder, self.most_bytes = spark, folder.rstrip("/"), most_bytes

    def _read(self, number: int, what: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{number}/{what}")

    def adds(self) -> list[int]:
        """Numbers of the adds that are whole."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        files = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in files.listStatus(path)] if files.exists(path) else []
        whole = lambda n: files.exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path, f"{n}/sizes/_SUCCESS"))
        return sorted(int(n) for n in names if n.isdigit() and whole(n))

    def levels(self) -> dict[int, int]:
        """Entries of each level, by the number of the add that wrote it; levels that were merged into a later one are gone."""
        out: dict[int, int] = {}
        for number in self.adds():
            for r in self._read(number, "sizes").collect():
                if r.gone is not None:
                    out.pop(r.gone, None)
                else:
                    out[number] = r.entries
        return out

    def add(self, docs: DataFrame) -> int:
        """Scan the documents (doc_id, text) against all levels, and keep them; the number of this add."""
        docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        adds, levels = self.adds(), self.levels()
        number = max(adds, default=0) + 1
        at = f"{self.folder}/{number}"
        docs.mapInArrow(_pack(self.most_bytes, number), ROWS).write.mode("overwrite").parquet(f"{at}/texts")
        texts = self._read(number, "texts")
        parts = sum(_shares(self._read(k, "texts"), self.most_bytes) for k in [*adds, number])
        # about every 18th suffix is sampled
        size, merged = (texts.agg(F.sum("part")).first()[0] or 0) // 18, []
        for k in sorted(levels, key=lambda k: levels[k]):
            if levels[k] <= 2 * size:
                size += levels[k]
                merged.append(k)
        stored = [self._read(k, "state").where(F.col("kind") == "L").withColumn("kind", F.lit("A" if k in merged else "B")) for k in levels]
        stored += [self._read(k, "state").where("kind in ('K', 'V')") for k in adds]
        before = functools.reduce(DataFrame.unionByName, stored) if stored else None
        _matched(texts, parts, 0, 1, before, keep=True).write.mode("overwrite").parquet(f"{at}/state")
        entries = self._read(number, "state").where("kind = 'L'").agg(F.coalesce(F.sum("bid"), F.lit(0))).first()[0]
        self.spark.createDataFrame([(entries, None), *((0, k) for k in merged)], "entries long, gone long").coalesce(1).write.mode("overwrite").parquet(f"{at}/sizes")
        return number

    def removed_spans(self) -> DataFrame:
        """The result of `removed_spans` for all documents added so far."""
        adds = self.adds()
        texts = functools.reduce(DataFrame.unionByName, [self._read(k, "texts") for k in adds])
        matched = functools.reduce(DataFrame.unionByName, [self._read(k, "state").where("kind = 'F'") for k in adds])
        return _cut_out(texts, matched, _shares(texts, self.most_bytes), 0, 1, _digest, SPANS)


SPANS = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def removed_spans(docs: DataFrame, most_bytes: int = BATCH_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the digest of what stays, for each row of `docs` (doc_id, text)."""
    return _run(docs.select("doc_id", "text"), _digest, SPANS, most_bytes)


def without_repeats(docs: DataFrame) -> DataFrame:
    """`docs` with every column, the repeated bytes cut out of text."""
    return _run(docs, _kept_text, docs.schema)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed_spans(read_table(spark, sf_dir, "documents"))


QUERIES = {"op8_suffix_dedup": op8_suffix_dedup}
# every 50-byte string of every document, with the least doc_id that has it; bytes as pairs of hexadecimal digits
ORACLES = {
    "op8_suffix_dedup": """WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
 x AS (SELECT doc_id, unnest(range(0, greatest(length(h) // 2 - 49, 0))) AS i, unnest(list_transform(range(0, greatest(length(h) // 2 - 49, 0)), lambda k: substr(h, 2 * k + 1, 100))) AS s FROM t),
 m AS (SELECT s, min(doc_id) AS least FROM x GROUP BY s),
 hit AS (SELECT x.doc_id, x.i FROM x JOIN m ON x.s = m.s AND m.least < x.doc_id),
 run AS (SELECT doc_id, i, sum(CASE WHEN i - before <= 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM hit) q),
 span AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM run GROUP BY doc_id, g),
 piece AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS free FROM span),
 cut AS (SELECT p.doc_id, CAST(sum(p.b - p.a) AS BIGINT) AS gone, count(*) AS n, string_agg(substr(t.h, 2 * p.free + 1, 2 * (p.a - p.free)), '' ORDER BY p.a) || substr(max(t.h), 2 * max(p.b) + 1) AS kept FROM piece p JOIN t ON p.doc_id = t.doc_id GROUP BY p.doc_id)
SELECT t.doc_id AS doc_id, CAST(length(t.h) // 2 AS BIGINT) AS n_bytes, coalesce(cut.gone, 0) AS n_removed, CAST(coalesce(cut.n, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(cut.kept, t.h))) AS kept_sha256 FROM t LEFT JOIN cut ON t.doc_id = cut.doc_id"""
}
