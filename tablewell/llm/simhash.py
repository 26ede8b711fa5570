"""SimHash near-dedup (operator 10), with pigeonring filtering.

A fingerprint has 64 bits; bit b is 1 if it is set in over half of the XXH64 values of a text's shingles. Fingerprints that
differ in at most `DISTANCE` bits link, and linked ones form components.

Candidates: the 64 bits are cut into DISTANCE + 1 segments on a ring. If two fingerprints differ in at most d bits, some
segment starts a chain whose first l segments differ in at most floor(l * d / (d + 1)) bits in total, for each l. So the
first segment of such a chain agrees and the second differs in one bit at most. Both go into the key (with each bit of
the second segment left out in turn), fingerprints of equal key meet in one sorted shuffle, and within a key the budgets
of the longer chains are checked before the full Hamming distance. Only distinct fingerprints take part.

Within a key no pair list is made: a frontier search reports a spanning forest of the links, which keeps every component.
Keys with more than `MOST` fingerprints are cut into blocks, and each pair of blocks is searched as a task of its own.

Defined results: null and blank texts have fingerprint zero and link like any other; a null doc_id is never a component's
smallest unless all are null; repeated rows each get their row; empty tables give empty results.

The pipeline's stage asks for more: texts whose sets of five-word shingles have a Jaccard similarity of `SIMILAR` or more.
It takes a SimHash of the set of each text's word pairs, and searches all links of `DISTANCE` bits among these by the same
chains; of a text's links the one whose sketch agrees most is a candidate. Not all texts that are so similar have SimHashes
that near, and where they differ in more bits no key is selective, so `one_of_each_similar` adds those that only
min-wise hashes find: `BANDS` keys of `ROWS` values each, of which a pair at 0.8 shares one with probability 0.9998. Groups of
one key of up to `FEW` texts give all pairs, larger ones a spanning tree of greatest estimated similarity, and each link
is verified by the shingle sets themselves before it counts, whichever way it came. Where a larger group stays in several components, all texts
outside its largest one are compared with the whole group by their shingle sets, so no link among its texts is missed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import free_name, join_skewed, materialise, read_table, shuffle_width, slices
from .components import components

WORDS = 4
SEED = 42
DISTANCE = 4
MOST = 16384
PAIRS = "kind string, key long, a long, b long"
SIMILAR_WORDS = 5
SIMILAR = 0.8
PRINT_WORDS = 2
BANDS, ROWS = 16, 4
FEW = 16
BLOCK = 2048


def _tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _hashes(parts: list[bytes], words: int) -> np.ndarray:
    """XXH64 of each shingle of a text that has words."""
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    reach = min(words, len(parts)) - 1
    cuts = zip(starts[: len(parts) - reach].tolist(), ends[reach:].tolist(), strict=True)
    return np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in cuts], dtype="<u8")


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The unsigned 64-bit fingerprint of one text."""
    parts = _tokens(text)
    if not parts:
        return 0
    return _bits(_hashes(parts, words))


def _bits(hashes: np.ndarray) -> int:
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 65536):
        ones += np.unpackbits(hashes[k : k + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def _with_fingerprints(text_at: int, keep: list[int], name: str, words: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 8 << 20):
            marks = np.array([fingerprint(t, words) for t in batch.column(text_at).to_pylist()], np.uint64).view(np.int64)
            names = [batch.schema.names[k] for k in keep]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(marks)], names=[*names, name])

    return run


def with_fingerprints(docs: DataFrame, name: str, only_id: bool = False, words: int = WORDS) -> DataFrame:
    """`docs` (or its doc_id) with the fingerprint of text, as a signed long, under `name`."""
    keep = [docs.columns.index("doc_id")] if only_id else list(range(len(docs.columns)))
    fields = [docs.schema.fields[k] for k in keep]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), f"`{name}` long"])
    return docs.mapInArrow(_with_fingerprints(docs.columns.index("text"), keep, name, words), schema)


def segments(distance: int) -> list[int]:
    """Masks of distance + 1 segments of nearly equal width."""
    n = distance + 1
    edges = [round(k * 64 / n) for k in range(n + 1)]
    return [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]


def chains(distance: int) -> np.ndarray:
    """[start, length - 1]: the bits of the chain of that length from that segment."""
    masks = segments(distance)
    n = len(masks)
    return np.array([[sum(masks[(i + k) % n] for k in range(length)) for length in range(1, n + 1)] for i in range(n)], dtype=np.uint64)


def _keys(distance: int) -> Callable:
    """Two columns, key and fingerprint: a row for each fingerprint, chain start and left-out bit."""
    masks = segments(distance)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in (b.column(0).to_numpy().view(np.uint64) for b in slices(batches, 1 << 18)):
            for i, mask in enumerate(masks):
                after = masks[(i + 1) % len(masks)]
                for j in (j for j in range(64) if after >> j & 1):
                    key = (x & np.uint64(mask | (after & ~(1 << j)))) + np.uint64(0xD6E8FEB86659FD93 * (i * 64 + j + 1) % 2**64)
                    key = (key ^ (key >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
                    key = (key >> np.uint64(4)) | np.uint64(i << 60)
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(x.view(np.int64))], names=["key", "a"])

    return run


class _Linker:
    """Links within runs of one key: chain budgets first, then all bits."""

    def __init__(self, distance: int) -> None:
        self.chains = chains(distance)
        n = len(self.chains)
        self.budgets = [length * distance // n for length in range(1, n + 1)]

    def linked(self, differ: np.ndarray, start: np.ndarray | int) -> np.ndarray:
        """Which of the differences pass."""
        live = np.arange(len(differ))
        for k, budget in enumerate(self.budgets):
            own = self.chains[start if isinstance(start, int) else start[live], k]
            live = live[np.bitwise_count(differ[live] & own) <= budget]
        return live

    def pairs(self, key: np.ndarray, x: np.ndarray, longest: int) -> Iterator[pa.RecordBatch]:
        """All links in runs of at most `longest` entries."""
        for d in range(1, longest):
            at = np.flatnonzero(key[d:] == key[:-d])
            got = at[self.linked(x[at] ^ x[at + d], (key[at] >> 60).astype(np.int64))]
            if len(got):
                yield _out("L", key[got], x[got], x[got + d])

    def forest(self, key: int, x: np.ndarray, rest: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
        """A spanning forest of the links in one run, found by search from one entry to the next; with `rest`, of the
        links between the two sides."""
        start, a, b = int(key >> 60), [], []
        sides = [x, rest] if rest is not None else [x]
        own = 0
        while len(sides[0]):
            todo = [(0, sides[0][0])]
            sides[0] = sides[0][1:]
            while todo:
                side, one = todo.pop()
                other = own if rest is None else 1 - side
                got = self.linked(sides[other] ^ one, start)
                if len(got):
                    found = sides[other][got]
                    a.append(np.full(len(found), one))
                    b.append(found)
                    todo += [(other, f) for f in found]
                    sides[other] = np.delete(sides[other], got)
        if a:
            a, b = np.concatenate(a), np.concatenate(b)
            yield _out("L", np.full(len(a), key), a, b)


def _out(kind: str, key: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array(np.ascontiguousarray(c).view(np.int64)) for c in (key, a, b)]
    return pa.RecordBatch.from_arrays([pa.array([kind] * len(a), pa.string()), *columns], names=["kind", "key", "a", "b"])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sorted (key, fingerprint) columns, cut between keys."""
    held_key, held = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    for batch in batches:
        key = np.concatenate([held_key, batch.column(0).to_numpy()])
        x = np.concatenate([held, batch.column(1).to_numpy().view(np.uint64)])
        cut = int(np.searchsorted(key, key[-1])) if len(key) else 0
        if cut:
            yield key[:cut], x[:cut]
        held_key, held = key[cut:], x[cut:]
    if len(held_key):
        yield held_key, held


def _links(distance: int, most: int, few: int = 8) -> Callable:
    """From rows sorted by key: links that span each key's links; the rows of keys with over `most` entries as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        linker = _Linker(distance)
        for key, x in _runs(batches):
            lead = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            size = np.diff(np.append(lead, len(key)))
            each = np.repeat(size, size)
            short = (each > 1) & (each <= few)
            yield from linker.pairs(key[short], x[short], few)
            for at, n in zip(lead[size > few], size[size > few], strict=True):
                one, k = x[at : at + n], key[at : at + n]
                yield from [_out("B", k, one, np.full(n, n, np.int64))] if n > most else linker.forest(k[0], one)

    return run


def _block_links(distance: int) -> Callable:
    """From rows (key, one block, other block, side, fingerprint) sorted by the first four: spanning links of each pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        linker, held, name = _Linker(distance), {0: [], 1: []}, None

        def close() -> Iterator[pa.RecordBatch]:
            if name is not None:
                first, second = (np.concatenate(held[k]) if held[k] else np.zeros(0, np.uint64) for k in (0, 1))
                yield from linker.forest(np.int64(name[0]), first, None if name[1] == name[2] else second)

        for batch in batches:
            columns = [c.to_numpy() for c in batch.columns]
            heads = np.stack(columns[:4], 1)
            cuts = np.concatenate([[0], np.flatnonzero((heads[1:] != heads[:-1]).any(1)) + 1, [len(heads)]])
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if lo == hi:
                    continue
                here = tuple(int(v) for v in heads[lo, :3])
                if here != name:
                    yield from close()
                    held, name = {0: [], 1: []}, here
                held[int(heads[lo, 3])].append(columns[4][lo:hi].view(np.uint64))
        yield from close()

    return run


def links(marks: DataFrame, distance: int = DISTANCE, most: int = MOST) -> DataFrame:
    """Links (a, b) among the distinct fingerprints of `marks` (mark), enough to span every component."""
    width = shuffle_width(marks.sparkSession)
    keyed = marks.select("mark").mapInArrow(_keys(distance), "key long, a long").repartition(width, "key").sortWithinPartitions("key", "a")
    found = materialise(keyed.mapInArrow(_links(distance, most), PAIRS))
    big = found.where("kind = 'B'").select("key", "a", F.ceil(F.col("b") / (most // 2)).alias("n"), F.pmod(F.xxhash64("a"), F.ceil(F.col("b") / (most // 2))).alias("own"))
    pairs = big.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).select(
        "key",
        F.least("own", "other").alias("one"),
        F.greatest("own", "other").alias("two"),
        (F.col("own") > F.col("other")).cast("long").alias("side"),
        "a",
    )
    blocks = pairs.repartition(width, "key", "one", "two").sortWithinPartitions("key", "one", "two", "side", "a").mapInArrow(_block_links(distance), PAIRS)
    return found.where("kind = 'L'").unionByName(blocks).select("a", "b")


def roots(marks: DataFrame, distance: int = DISTANCE, most: int = MOST) -> DataFrame:
    """(mark, root) for the fingerprints that link with another one."""
    return components(links(marks, distance, most)).toDF("mark", "root")


def _least_of_components(classes: DataFrame, rooted: DataFrame) -> DataFrame:
    """`classes` (mark, least and others) and the least of their component under `first`; `rooted` (mark, root) has those
    that link. One component may hold most marks."""
    own = materialise(classes.join(rooted, "mark", "left"))
    linked = own.where("root is not null")
    best = materialise(linked.groupBy("root").agg(F.min("least").alias("first"), F.count("*").alias("n")))
    with_first = join_skewed(linked, best, "root", "n").drop("root")
    return with_first.unionByName(own.where("root is null").drop("root").withColumn("first", F.col("least")))


def near_duplicate_components(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id for every row of `docs` (doc_id, text)."""
    marked = materialise(with_fingerprints(docs.select("doc_id", "text"), "mark", only_id=True))
    classes = materialise(marked.groupBy("mark").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows")))
    named = materialise(_least_of_components(classes, roots(classes)).select("mark", F.col("first").alias("component_id"), "rows"))
    return join_skewed(marked, named, "mark", "rows").select("doc_id", F.lpad(F.lower(F.hex("mark")), 16, "0").alias("fingerprint"), "component_id")


def _survivors(docs: DataFrame, marked: DataFrame, mark: str, classes: DataFrame, rooted: DataFrame) -> DataFrame:
    """`docs` with all columns, of each component one row of its smallest doc_id: of several the one whose columns have the
    least digest. `marked` is `docs` with each row's class under `mark`. Texts are shuffled once, by digest."""
    digest = free_name(marked.columns, "digest__")
    every = marked.withColumn(digest, F.unhex(F.sha2(F.to_json(F.struct(*(F.col(f"`{c}`") for c in docs.columns))).cast("binary"), 256)))
    whole = materialise(classes.select("mark", "least").join(rooted, "mark", "left").select("mark", "least", F.coalesce("root", "mark").alias("root")))
    first = whole.groupBy("root").agg(F.min("least").alias("first"))
    chosen = whole.join(first, "root").where(F.col("least").eqNullSafe(F.col("first"))).select("mark", "least", "root")
    # a class may hold very many rows, but few of one doc_id, which is part of the key
    ids = every.select(F.col("doc_id").alias("id"), F.col(f"`{mark}`").alias("own"), F.col(f"`{digest}`").alias("digest"))
    met = ids.join(chosen, (F.col("own") == F.col("mark")) & F.col("id").eqNullSafe(F.col("least")))
    best = met.groupBy("root").agg(F.min("digest").alias(digest)).select(digest)
    return every.join(best, digest, "left_semi").dropDuplicates([digest]).select(*(F.col(f"`{c}`") for c in docs.columns))


def one_of_each(docs: DataFrame) -> DataFrame:
    """`docs` with all columns, one row of each component: that with the smallest doc_id (of equal ones that whose columns
    have the least digest)."""
    mark = free_name(docs.columns, "mark__")
    classes = materialise(with_fingerprints(docs, mark, only_id=True).groupBy(F.col(mark).alias("mark")).agg(F.min("doc_id").alias("least")))
    return _survivors(docs, with_fingerprints(docs, mark), mark, classes, roots(classes))


def _factors() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.integers(0, 2**64, BANDS * ROWS, dtype=np.uint64) | np.uint64(1), rng.integers(0, 2**64, BANDS * ROWS, dtype=np.uint64)


def _mark(parts: list[bytes]) -> int:
    return xxh64_intdigest(b" ".join(parts), SEED)


def _marks(text_at: int, name: str) -> Callable:
    """All columns, and a hash of the words of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 8 << 20):
            marks = np.array([_mark(_tokens(t)) for t in batch.column(text_at).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(marks)], names=[*batch.schema.names, name])

    return run


def _sketches(words: int, print_words: int | None = None) -> Callable:
    """From (doc_id, text): doc_id, mark, the keys of the bands (none for blank texts), a byte of each min-wise hash and, with
    `print_words`, the SimHash of the set of shingles of so many words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factor, shift = _factors()
        band = np.arange(BANDS, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        for batch in slices(batches, 8 << 20):
            marks, keys, sketches, prints = [], [], [], []
            for text in batch.column(1).to_pylist():
                parts = _tokens(text)
                marks.append(_mark(parts))
                if print_words is not None:
                    prints.append(_bits(np.unique(_hashes(parts, print_words))) if parts else 0)
                if not parts:
                    keys.append([])
                    sketches.append(b"")
                    continue
                hashes = _hashes(parts, words)
                least = np.min([(hashes[k : k + 512, None] * factor + shift).min(0) for k in range(0, len(hashes), 512)], axis=0)
                mixed = band.copy()
                for column in least.reshape(BANDS, ROWS).T:
                    mixed = (mixed ^ column) * np.uint64(0x9E3779B97F4A7C15)
                    mixed ^= mixed >> np.uint64(29)
                keys.append(mixed.view(np.int64))
                sketches.append(((least * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(56)).astype(np.uint8).tobytes())
            columns = [batch.column(0), pa.array(np.array(marks, np.uint64).view(np.int64)), pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.binary())]
            names = ["doc_id", "mark", "keys", "sketch"]
            if print_words is not None:
                columns, names = [*columns, pa.array(np.array(prints, np.uint64).view(np.int64))], [*names, "print"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def _likely(similar: float) -> int:
    """Bytes of a sketch that agree in all but about one of a million pairs of that similarity (five deviations less)."""
    n = BANDS * ROWS
    return int(n * similar - 5 * (n * similar * (1 - similar)) ** 0.5)


def _candidates(sketch: np.ndarray, least: int, few: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs in one group whose sketches agree in `least` bytes: all in small groups, else a spanning forest of most agreement."""
    n = len(sketch)
    if n <= few:
        a, b = np.triu_indices(n, 1)
        good = (sketch[a] == sketch[b]).sum(1) >= least
        return a[good], b[good]
    rest, best, source, out = np.arange(1, n), np.full(n - 1, -1), np.zeros(n - 1, np.int64), []
    at = 0
    while len(rest):
        agree = (sketch[rest] == sketch[at]).sum(1)
        nearer = agree > best
        best[nearer], source[nearer] = agree[nearer], at
        k = int(best.argmax())
        at = int(rest[k])
        if best[k] >= least:
            out.append((int(source[k]), at))
        rest, best, source = (np.delete(x, k) for x in (rest, best, source))
    pairs = np.array(out, np.int64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


NEAR = "key long, a long, b long, sketch binary"


def _near(least: int, heads: int, few: int, most: int, keep: bool = True) -> Callable:
    """Candidates from rows (group columns, mark, sketch) sorted by their first `heads` columns; of groups of over `few`, with
    `keep`, the rows with the group's size too, and of those over `most` only these, with their sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close() -> Iterator[pa.RecordBatch]:
            mark = np.concatenate([h[0] for h in held])
            sketch = [s for h in held for s in h[1]]
            if keep and len(mark) > few:
                columns = [np.full(len(mark), name[0]), mark, np.full(len(mark), len(mark))]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(sketch if len(mark) > most else [b""] * len(mark), pa.binary())], names=["key", "a", "b", "sketch"])
            if 1 < len(mark) <= most:
                a, b = _candidates(np.frombuffer(b"".join(sketch), np.uint8).reshape(len(mark), -1), least, few)
                if len(a):
                    columns = [np.full(len(a), name[0]), np.minimum(mark[a], mark[b]), np.maximum(mark[a], mark[b])]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.nulls(len(a), pa.binary())], names=["key", "a", "b", "sketch"])

        held, name = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            head = np.stack([batch.column(k).to_numpy() for k in range(heads)], 1)
            mark = batch.column(heads).to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero((head[1:] != head[:-1]).any(1)) + 1, [len(head)]]).tolist()
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if (here := tuple(head[lo].tolist())) != name:
                    if name is not None:
                        yield from close()
                    held, name = [], here
                held.append((mark[lo:hi], batch.column(heads + 1).slice(lo, hi - lo).to_pylist()))
        if name is not None:
            yield from close()

    return run


def _verified(similar: float) -> Callable:
    """From (a, b, shingles of a, shingles of b): the links whose sets are as similar as asked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                one, two = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                both = len(np.intersect1d(one, two, assume_unique=True))
                good.append(both >= similar * (len(one) + len(two) - both) - 1e-9)
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    return run


def _across(similar: float) -> Callable:
    """From rows (key, straggler block, block, side, mark, root, shingles) sorted by the first four: a link from each
    straggler (side 1) to each other root that has a text (side 0) as similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close() -> Iterator[pa.RecordBatch]:
            side, mark, root = (np.concatenate([h[k] for h in held]) for k in range(3))
            sets = [np.frombuffer(x, "<u8") for h in held for x in h[3]]
            rows = np.flatnonzero(side == 0)
            size = np.array([len(sets[k]) for k in rows], np.int64)
            if not len(rows):
                return
            values = np.concatenate([sets[k] for k in rows])
            order = np.argsort(values, kind="stable")
            values, owner = values[order], np.repeat(np.arange(len(rows)), size)[order]
            out = []
            for k in np.flatnonzero(side == 1):
                lo, hi = np.searchsorted(values, sets[k]), np.searchsorted(values, sets[k], "right")
                n = hi - lo
                both = np.bincount(owner[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))], minlength=len(rows))
                good = rows[(both >= similar * (size + len(sets[k]) - both) - 1e-9) & (root[rows] != root[k])]
                out += [(mark[k], mark[good[j]]) for j in np.unique(root[good], return_index=True)[1]]
            if out:
                pairs = np.array(out, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        held, name = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(k).to_numpy() for k in range(6)]
            head = np.stack(columns[:3], 1)
            cuts = np.concatenate([[0], np.flatnonzero((head[1:] != head[:-1]).any(1)) + 1, [len(head)]]).tolist()
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if (here := tuple(head[lo].tolist())) != name:
                    if name is not None:
                        yield from close()
                    held, name = [], here
                held.append((*(c[lo:hi] for c in columns[3:]), batch.column(6).slice(lo, hi - lo).to_pylist()))
        if name is not None:
            yield from close()

    return run


def _shingle_sets(words: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 8 << 20):
            sets = [np.unique(_hashes(parts, words)).tobytes() if (parts := _tokens(t)) else b"" for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["mark", "shingles"])

    return run


def _agreeing(least: int) -> Callable:
    """From (a, b, sketch of a, sketch of b): the pairs, smaller mark first, whose sketches agree in `least` bytes, and in how many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(k).to_numpy() for k in (0, 1))
            one, two = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(len(a), -1) if len(a) else np.zeros((0, 1), np.uint8) for k in (2, 3))
            agree = (one == two).sum(1)
            good = agree >= least
            columns = [np.minimum(a, b)[good], np.maximum(a, b)[good], agree[good].astype(np.int64)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns)], names=["a", "b", "agree"])

    return run


def simhash_candidates(classes: DataFrame, similar: float, distance: int = DISTANCE, most: int = MOST) -> DataFrame:
    """Pairs (a, b) of marks of `classes` (mark, keys, sketch, print) whose SimHashes link and whose sketches are as like as
    those of similar texts: for each mark at most one, with a smaller mark."""
    some = classes.where("size(keys) > 0").select("print", "mark", "sketch")
    prints = materialise(some.groupBy("print").agg(F.min(F.struct("mark", "sketch")).alias("first"), F.count("*").alias("n")))
    equal = join_skewed(some, prints, "print", "n").where("mark <> first.mark")
    pairs = equal.select(F.col("first.mark").alias("a"), F.col("mark").alias("b"), F.col("first.sketch").alias("one"), F.col("sketch").alias("two"))
    met = materialise(links(prints.select(F.col("print").alias("mark")), distance, most).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    for side, name in (("a", "one"), ("b", "two")):
        degree = met.groupBy(side).agg(F.count("*").alias("n"))
        met = join_skewed(met, materialise(prints.select(F.col("print").alias(side), F.col("first").alias(name)).join(degree, side)), side, "n")
    both = pairs.unionByName(met.select(F.col("one.mark").alias("a"), F.col("two.mark").alias("b"), F.col("one.sketch").alias("one"), F.col("two.sketch").alias("two")))
    near = both.mapInArrow(_agreeing(_likely(similar)), "a long, b long, agree long")
    return near.groupBy("b").agg(F.max(F.struct("agree", "a")).alias("best")).select(F.col("best.a").alias("a"), "b")


def similar_links(docs: DataFrame, classes: DataFrame, words: int, similar: float, few: int = FEW, block: int = BLOCK, near: DataFrame | None = None) -> DataFrame:
    """Verified links (a, b) that span the components of the marks of `classes` (mark, keys, sketch); `docs` (mark, text)
    has their texts. `near` has further candidates (a, b)."""
    width, least = shuffle_width(docs.sparkSession), _likely(similar)
    # most keys have one text; sketches go only with the others
    shared = classes.select(F.explode("keys").alias("key"), "mark").withColumn("n", F.count("*").over(Window.partitionBy("key"))).where("n > 1")
    keyed = shared.select("key", "mark").join(classes.select("mark", "sketch"), "mark").select("key", "mark", "sketch")
    found = materialise(keyed.repartition(width, "key").sortWithinPartitions("key", "mark").mapInArrow(_near(least, 1, few, 2 * block), NEAR))
    big = found.where(f"b > {2 * block} and length(sketch) > 0").select("key", F.pmod(F.xxhash64("a", "key"), F.ceil(F.col("b") / block)).alias("own"), "a", "sketch")
    blocks = big.repartition(width, "key", "own").sortWithinPartitions("key", "own", "a").mapInArrow(_near(least, 2, few, 2**62, keep=False), NEAR)
    candidates = found.where("sketch is null").select("a", "b").unionByName(blocks.select("a", "b"))
    tried = materialise((candidates if near is None else near.unionByName(candidates)).distinct())
    large = found.where("sketch is not null").select("key", F.col("a").alias("mark"))
    wanted = tried.select(F.col("a").alias("mark")).unionByName(tried.select(F.col("b").alias("mark"))).unionByName(large.select("mark")).distinct()
    # copies are reduced to one before the shuffle, so a class of very many of them is no hot key
    texts = docs.select("mark", "text").dropDuplicates(["mark"]).join(wanted, "mark", "left_semi")
    sets = materialise(texts.mapInArrow(_shingle_sets(words), "mark long, shingles binary"))
    first, second = sets.toDF("a", "first"), sets.toDF("b", "second")
    good = materialise(tried.join(first, "a").join(second, "b").select("a", "b", "first", "second").mapInArrow(_verified(similar), "a long, b long"))
    if large.isEmpty():
        return good
    now = large.join(components(good).toDF("mark", "root"), "mark", "left").withColumn("root", F.coalesce("root", "mark"))
    now = materialise(now.select("key", "mark", "root"))
    sizes = now.groupBy("key", "root").agg(F.count("*").alias("n")).groupBy("key").agg(F.max(F.struct("n", "root")).alias("top"), F.sum("n").alias("n"))
    split = sizes.where("n > top.n").select("key", F.col("top.root").alias("most"), F.ceil(F.col("n") / block).alias("m"), F.ceil((F.col("n") - F.col("top.n")) / block).alias("s"), "n")
    rows = join_skewed(now, materialise(split), "key", "n")
    to = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    own = lambda c: F.pmod(F.xxhash64("mark"), F.col(c))
    members = rows.select("key", to("s").alias("one"), own("m").alias("two"), F.lit(0).cast("long").alias("side"), "mark", "root")
    stragglers = rows.where("root <> most").select("key", own("s").alias("one"), to("m").alias("two"), F.lit(1).cast("long").alias("side"), "mark", "root")
    both = members.unionByName(stragglers).join(sets, "mark").select("key", "one", "two", "side", "mark", "root", "shingles")
    more = both.repartition(width, "key", "one", "two").sortWithinPartitions("key", "one", "two", "side").mapInArrow(_across(similar), "a long, b long")
    return good.unionByName(more)


def one_of_each_similar(docs: DataFrame, words: int = SIMILAR_WORDS, similar: float = SIMILAR) -> DataFrame:
    """`docs` with all columns, one row of each component of texts whose shingles are as similar: that with the smallest
    doc_id (of equal ones that whose columns have the least digest). Blank texts are similar to each other only."""
    mark = free_name(docs.columns, "mark__")
    sketched = docs.select("doc_id", "text").mapInArrow(_sketches(words, PRINT_WORDS), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, mark long, keys array<long>, sketch binary, print long")
    classes = materialise(sketched.groupBy("mark").agg(F.min("doc_id").alias("least"), *(F.first(c).alias(c) for c in ("keys", "sketch", "print"))))
    marked = docs.mapInArrow(_marks(docs.columns.index("text"), mark), ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), f"`{mark}` long"]))
    links_ = similar_links(marked.select(F.col(mark).alias("mark"), "text"), classes, words, similar, near=simhash_candidates(classes, similar))
    return _survivors(docs, marked, mark, classes, components(links_).toDF("mark", "root"))


def op10_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_components(read_table(spark, sf_dir, "documents"))


QUERIES = {"op10_simhash_components": op10_simhash_components}
ORACLES: dict[str, str] = {}
