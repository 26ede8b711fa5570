"""Best-fit packing (operator 1): documents into sequences of at most `ROOM` tokens, by a grouping genetic algorithm.

A document is its ids and an end token. One longer than a sequence is cut into pieces of `ROOM`, of which the first may be
shorter; full pieces are sequences by themselves. The rest is dealt at random into shards of about `SHARD` pieces. On each
shard several islands, each a task of its own, evolve a population of packings: a crossover injects whole well-filled bins
of one parent into the other, drops the bins that now hold duplicates, and best-fits the displaced documents. Between two
epochs each island gets its neighbour's elite; then the best packing of the shard stays. The pieces of bins that aren't
well filled are dealt anew and packed once more, so what a shard leaves over is filled up with what others leave.

Nothing but counts reaches the driver; a task holds one shard, however large the table is.

Defined results: null text counts as empty, which is one end token; each repeated row is a document of its own; null
doc_ids pass; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import random
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import materialise, read_table, shuffle_width, slices

ROOM = 1024
END = 2
SHARD = 4000
ISLANDS = 3
POPULATION = 12
CORE = 80
WORK = 24_000
WELL_FILLED = 0.99
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _byte_of() -> dict[str, int]:
    """The byte-level alphabet of the vocabulary file: printable bytes stand for themselves, others for 256 and up."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def _merged(token: str, rank: dict[tuple[str, str], int]) -> list[str]:
    """What is left of a token's characters by the file's merges alone."""
    parts = list(token)
    while len(parts) > 1:
        best, k = min((rank.get(pair, len(rank)), k) for k, pair in enumerate(zip(parts, parts[1:], strict=False)))
        if best == len(rank):
            break
        parts[k : k + 2] = [parts[k] + parts[k + 1]]
    return parts


@lru_cache(maxsize=2)
def check_vocabulary(path: str) -> None:
    """ValueError unless merging by the ids of the joined tokens is the same as by the file's merges.

    It is if the merges give their tokens in the order of the ids and each token comes out of its own characters: two
    neighbours whose join is a token are then the pair of its merge, because any other pair would have been merged before.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab, merges = spec["model"]["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
    rank = {pair: k for k, pair in enumerate(merges)}
    made = [vocab.get(a + b, -1) for a, b in merges]
    added = {t["content"] for t in spec["added_tokens"]}
    plain = [t for t in vocab if t not in added]
    wrong = made != sorted(made) or len(set(made)) != len(made) or any(len(_merged(t, rank)) > 1 for t in plain)
    odd = any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip")) or spec.get("normalizer")
    if wrong or odd or set(_byte_of()) - set(plain):
        raise ValueError(f"{path} is no byte-level vocabulary with merges in the order of ids")


@lru_cache(maxsize=2)
def _tokenizer(path: str) -> tiktoken.Encoding:
    """The vocabulary of a tokenizers file (see `check_vocabulary`), run by tiktoken, which takes a fraction of the time for
    the same ids. The file's added tokens are found in texts, as tokenizers does."""
    own = Tokenizer.from_file(path)
    added = {t.content: k for k, t in own.get_added_tokens_decoder().items()}
    byte_of = _byte_of()
    ranks = {bytes(byte_of[c] for c in token): k for token, k in own.get_vocab().items() if token not in added}
    return tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)


class _Encoder:
    """Ids of texts as little-endian 32-bit bytes."""

    def __init__(self, path: str) -> None:
        self.tokenizer = _tokenizer(path)

    def batch(self, texts: list[str]) -> list[bytes]:
        return [array("I", self.tokenizer.encode(t, allowed_special="all")).tobytes() for t in texts]


def cut_points(n: int, room: int = ROOM) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n tokens."""
    first = n % room or min(n, room)
    return [(0, first)] + [(s, room) for s in range(first, n, room)]


def _pieces(path: str, end: int, room: int) -> Callable:
    tail = np.array([end], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _Encoder(path)
        for batch in slices(batches, 4 << 20):
            rows: list[tuple] = []
            for doc, ids in zip(batch.column(0).to_pylist(), encoder.batch([t or "" for t in batch.column(1).to_pylist()]), strict=True):
                ids += tail
                rows += [(doc, k, s, n, zlib.crc32(ids[4 * s : 4 * (s + n)])) for k, (s, n) in enumerate(cut_points(len(ids) // 4, room))]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


class _Bins:
    """Open bins by the room that is left, for best fit."""

    def __init__(self, room: int) -> None:
        self.by_room: list[list[int]] = [[] for _ in range(room + 1)]
        self.mask = 0

    def put(self, bin_: int, left: int) -> None:
        self.by_room[left].append(bin_)
        self.mask |= 1 << left

    def take(self, need: int) -> tuple[int, int] | None:
        """The bin with the least room of at least `need`."""
        up = self.mask >> need
        if not up:
            return None
        left = need + (up & -up).bit_length() - 1
        own = self.by_room[left]
        bin_ = own.pop()
        if not own:
            self.mask ^= 1 << left
        return bin_, left


def best_fit(lengths: list[int], items: list[int], bins: list[list[int]], room: int) -> list[list[int]]:
    """`bins` with `items` added in order, each where it leaves the least room."""
    open_ = _Bins(room)
    for k, members in enumerate(bins):
        open_.put(k, room - sum(lengths[i] for i in members))
    for i in items:
        n = lengths[i]
        got = open_.take(n)
        if got is None:
            bins.append([i])
            open_.put(len(bins) - 1, room - n)
        else:
            bins[got[0]].append(i)
            open_.put(got[0], got[1] - n)
    return bins


def fitness(lengths: list[int], bins: list[list[int]], room: int) -> float:
    return sum((sum(lengths[i] for i in b) / room) ** 2 for b in bins) / max(1, len(bins))


def crossover(lengths: list[int], giver: list[list[int]], taker: list[list[int]], room: int, rng: random.Random) -> list[list[int]]:
    """Inject a random part of the giver's well-filled bins into the taker; drop the bins that hold duplicates; best-fit what they lose."""
    full = [b for b in giver if sum(lengths[i] for i in b) >= WELL_FILLED * room] or giver
    chosen = rng.sample(full, max(1, len(full) // rng.randint(2, 5)))
    taken = {i for b in chosen for i in b}
    stay = [list(b) for b in taker if taken.isdisjoint(b)]
    # the emptiest bins are opened as well, else nothing new can come of them
    stay.sort(key=lambda b: sum(lengths[i] for i in b))
    n_open = len(stay) // 20
    lost = [i for b in taker if not taken.isdisjoint(b) for i in b if i not in taken] + [i for b in stay[:n_open] for i in b]
    lost.sort(key=lambda i: -lengths[i])
    return best_fit(lengths, lost, [list(b) for b in chosen] + stay[n_open:], room)


def least_bins(lengths: list[int], room: int) -> int:
    """A number of bins that no packing can go below: items over half a bin share none, and of items of at least k only those
    fit beside a larger one that leaves k."""
    count = np.bincount(np.asarray(lengths, np.int64), minlength=room + 1)
    items, total = np.concatenate([[0], np.cumsum(count)]), np.concatenate([[0], np.cumsum(count * np.arange(room + 1))])
    half = room // 2
    k = np.arange(half + 1)
    large = items[-1] - items[half + 1]
    beside = (items[room - k + 1] - items[half + 1]) * room - (total[room - k + 1] - total[half + 1])
    small = total[half + 1] - total[k]
    return int((large + np.maximum(0, -((beside - small) // room))).max())


def evolve(lengths: list[int], room: int, seed: int, migrants: list[list[list[int]]], population: int = POPULATION, work: int = WORK) -> list[list[int]]:
    """The elite of one island after some generations; it ends early where no packing can have fewer bins.

    What evolves is the core of the best packing so far: its emptiest bins and as many of the others. Its other bins stay as
    they are. Small shards evolve whole. Generations are as many as let crossovers place about `work` items.
    """
    rng = random.Random(seed)
    better = lambda bins: (len(bins), -fitness(lengths, bins, room))
    start = min(migrants, key=better) if migrants else best_fit(lengths, sorted(range(len(lengths)), key=lambda i: -lengths[i]), [], room)
    above = len(start) - least_bins(lengths, room)
    if above <= 0:
        return start
    rest: list[list[int]] = []
    core = start
    if len(start) > CORE:
        core = sorted(start, key=lambda b: sum(lengths[i] for i in b))
        others = core[CORE // 2 :]
        rng.shuffle(others)
        core, rest = core[: CORE // 2] + others[: CORE // 2], others[CORE // 2 :]
    items = [i for b in core for i in b]
    inside = set(items)
    least = max(len(core) - above, least_bins([lengths[i] for i in items], room))
    everyone = [core]
    for m in migrants:
        # what a migrant has of the core, with the items of its other bins placed anew
        whole = [list(b) for b in m if inside.issuperset(b)]
        placed = {i for b in whole for i in b}
        everyone.append(best_fit(lengths, sorted(inside - placed, key=lambda i: -lengths[i]), whole, room))
    while len(everyone) < population:
        shake = 0.1 + 0.9 * len(everyone) / population
        everyone.append(best_fit(lengths, sorted(items, key=lambda i: -lengths[i] * (1 + shake * rng.random())), [], room))
    scored = sorted(((better(bins), bins) for bins in everyone), key=lambda x: x[0])
    for _ in range(work // len(items)):
        if scored[0][0][0] <= least:
            break
        # better packings give more often
        giver, taker = int(len(scored) * rng.random() ** 2), int(len(scored) * rng.random())
        if giver != taker:
            child = crossover(lengths, scored[giver][1], scored[taker][1], room, rng)
            # a packing as good as another one is most likely the same
            if all(better(child) != s for s, _ in scored):
                scored = sorted([*scored, (better(child), child)], key=lambda x: x[0])[:population]
    return rest + scored[0][1]


def _as_labels(bins: list[list[int]], n: int) -> np.ndarray:
    out = np.zeros(n, "<u4")
    for k, members in enumerate(bins):
        out[members] = k
    return out


def _as_bins(labels: np.ndarray) -> list[list[int]]:
    order = np.argsort(labels, kind="stable")
    return [g.tolist() for g in np.split(order, np.flatnonzero(np.diff(labels[order])) + 1)]


ISLAND = "shard long, island long, sender long, ids binary, lengths binary, elite binary"
_ISLAND = pa.schema([(n, pa.int64()) for n in ("shard", "island", "sender")] + [(n, pa.binary()) for n in ("ids", "lengths", "elite")])


def _shards(islands: int) -> Callable:
    """From (shard, row, length) sorted by shard: a row for each shard and island."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        now = None

        def close() -> pa.RecordBatch:
            ids, lengths = (np.concatenate(x).astype(k).tobytes() for x, k in zip(zip(*held, strict=True), ("<i8", "<u4"), strict=True))
            return pa.RecordBatch.from_pylist([{"shard": now, "island": k, "sender": -1, "ids": ids, "lengths": lengths, "elite": None} for k in range(islands)], schema=_ISLAND)

        for batch in batches:
            shard, ids, lengths = (c.to_numpy() for c in batch.columns)
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(shard)) + 1, [len(shard)]])
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a < b:
                    if now is not None and shard[a] != now:
                        yield close()
                        held = []
                    now = int(shard[a])
                    held.append((ids[a:b], lengths[a:b]))
        if held:
            yield close()

    return run


def _epoch(room: int, epoch: int) -> Callable:
    """From rows sorted by shard and island: each island's elite, from its own start or from the elites sent to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def close() -> pa.RecordBatch:
            one = held[0]
            lengths = np.frombuffer(one["lengths"], "<u4").tolist()
            migrants = [_as_bins(np.frombuffer(r["elite"], "<u4")) for r in held if r["elite"] is not None]
            best = evolve(lengths, room, one["shard"] * 1009 + one["island"] * 31 + epoch, migrants)
            return pa.RecordBatch.from_pylist([one | {"sender": one["island"], "elite": _as_labels(best, len(lengths)).tobytes()}], schema=_ISLAND)

        for row in (r for b in batches for r in b.to_pylist()):
            if held and (row["shard"], row["island"]) != (held[0]["shard"], held[0]["island"]):
                yield close()
                held = []
            held.append(row)
        if held:
            yield close()

    return run


PLACED = "row long, sequence_id long, offset long, fill long"


def _settle(room: int, base: int) -> Callable:
    """From the elites sorted by shard: the best packing of each shard, a row for each piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict | None = None

        def score(r: dict) -> tuple:
            bins = _as_bins(np.frombuffer(r["elite"], "<u4"))
            return len(bins), -fitness(np.frombuffer(r["lengths"], "<u4").tolist(), bins, room), r["sender"]

        def close(r: dict) -> pa.RecordBatch:
            ids, lengths, labels = np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["lengths"], "<u4").astype(np.int64), np.frombuffer(r["elite"], "<u4")
            order = np.lexsort((ids, labels))
            n, label = lengths[order], labels[order]
            lead = np.flatnonzero(np.concatenate([[True], label[1:] != label[:-1]]))
            total = np.cumsum(n)
            size = np.diff(np.append(lead, len(n)))
            offset = total - n - np.repeat((total - n)[lead], size)
            fill = np.repeat(np.add.reduceat(n, lead), size)
            number = base + (r["shard"] << 20) + label.astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[order], number, offset, fill)], names=["row", "sequence_id", "offset", "fill"])

        for r in (r for b in batches for r in b.to_pylist()):
            if best is not None and r["shard"] != best["shard"]:
                yield close(best)
                best = None
            if best is None or score(r) < score(best):
                best = r
        if best is not None:
            yield close(best)

    return run


def _packed(items: DataFrame, n: int, room: int, base: int, salt: int) -> DataFrame:
    """(row, sequence_id, offset, fill) of the n items (row, length), packed shard by shard."""
    width = shuffle_width(items.sparkSession)
    shards = max(1, -(-n // SHARD))
    dealt = items.select(F.pmod(F.xxhash64("row", F.lit(salt)), F.lit(shards)).alias("shard"), "row", "length")
    instances = dealt.repartition(width, "shard").sortWithinPartitions("shard").mapInArrow(_shards(ISLANDS), ISLAND)
    together = lambda df: df.repartition(width, "shard", "island").sortWithinPartitions("shard", "island", "sender")
    first = together(instances).mapInArrow(_epoch(room, 0), ISLAND)
    moved = first.withColumn("island", F.explode(F.array("island", F.pmod(F.col("island") + 1, F.lit(ISLANDS)))))
    last = together(moved).mapInArrow(_epoch(room, 1), ISLAND)
    return last.repartition(width, "shard").sortWithinPartitions("shard", "sender").mapInArrow(_settle(room, base), PLACED)


def pack(docs: DataFrame, path: str, room: int = ROOM, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece of `docs` (doc_id, text)."""
    check_vocabulary(path)
    cut = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_pieces(path, end, room), PIECES)
    pieces = materialise(cut.withColumn("row", F.monotonically_increasing_id()))
    full = pieces.where(F.col("length") == room).select("*", (-F.col("row") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    open_ = pieces.where(F.col("length") < room)
    placed = materialise(_packed(open_.select("row", "length"), open_.count(), room, 0, 1))
    good = placed.where(F.col("fill") >= WELL_FILLED * room)
    rest = open_.select("row", "length").join(placed.where(F.col("fill") < WELL_FILLED * room).select("row"), "row")
    again = _packed(rest, placed.where(F.col("fill") < WELL_FILLED * room).count(), room, 1 << 61, 2)
    where = good.unionByName(again).select("row", "sequence_id", "offset")
    return full.unionByName(open_.join(where, "row")).drop("row")


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {"op1_pack": op1_pack}
ORACLES: dict[str, str] = {}
