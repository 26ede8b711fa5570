"""Deliveries folded across micro-batches, and token counts by windows."""

import random
from datetime import UTC, datetime, timedelta

import public_tokenizers
import pytest

from tablewell.functions import tokens
from tablewell.operators import chunk
from tablewell.streaming import deliveries

SCHEMA = "event string, `table` string, at timestamp, rows long, tombstones long, seq long, previous_generation long"
START = datetime(2024, 5, 1, tzinfo=UTC)


def made_events(n=400):
    rnd = random.Random(5)
    out = []
    for k in range(n):
        at = START + timedelta(milliseconds=k * 100 + rnd.randint(-1500, 1500))
        name = "hot" if k % 3 == 0 else rnd.choice(["a", "b", None])
        out.append((rnd.choice(["appended", "rolled_up"]), name, at, rnd.randint(0, 5), None if k % 7 else 1, (1 << 60) + k, k if k % 2 else None))
    return out


def expected(events, wait):
    out, keys = [], {}
    for e in events:
        keys.setdefault(e[:2], []).append(e)
    for key, own in keys.items():
        own.sort(key=lambda e: e[2])
        while own:
            due = [e for e in own if e[2] < own[0][2] + wait]
            figures = [[e[k] for e in due if e[k] is not None] for k in range(3, 7)]
            out.append((*key, due[0][2], *(f(x) if x else None for f, x in zip((sum, sum, max, min), figures, strict=True))))
            own = own[len(due) :]
    return sorted(out, key=str)


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, deliveries.PROVIDER)
    yield spark
    spark.conf.unset(key)


def delivered(spark, root, parts):
    """The deliveries of a stream that is started anew for each part, its last one closing all others."""
    for part in parts:
        spark.createDataFrame(part, SCHEMA).coalesce(2).write.mode("append").parquet(f"{root}/in")
        stream = deliveries.deliveries(spark.readStream.schema(SCHEMA).parquet(f"{root}/in"), 2000)
        query = stream.writeStream.format("parquet").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start(f"{root}/out")
        query.awaitTermination(120)
        assert query.exception() is None
    got = [(r.event, r.table, r.first.astimezone(UTC), r.rows, r.tombstones, r.seq, r.previous_generation) for r in spark.read.parquet(f"{root}/out").collect()]
    return sorted(got, key=str)


def test_deliveries_do_not_depend_on_micro_batches(rocks, tmp_path):
    events = made_events()
    last = [("end", "end", START + timedelta(hours=1), 0, 0, 0, None)]
    want = expected(events, timedelta(seconds=2))
    assert len(want) < 200
    assert delivered(rocks, tmp_path / "once", [events + last]) == want
    assert delivered(rocks, tmp_path / "halves", [events[:200], events[200:], last]) == want


def test_deliveries_need_the_state_store(spark):
    with pytest.raises(ValueError, match="providerClass"):
        deliveries.deliveries(spark.createDataFrame([], SCHEMA), 1000)


PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def test_tokens_of_windows_are_near_the_whole_count(spark):
    tokenizer = tokens.vocabulary(PATH, PATTERN)
    rnd = random.Random(3)
    words = ["harbour", "Über", "x9", "{\"a\": 1}", "the", "señal", "\n", "42"]
    for text in (" ".join(rnd.choice(words) for _ in range(60_000)), "ab" * 20_000 + " word" * 50_000):
        exact = len(tokenizer.encode_ordinary(text))
        got, error = tokens.token_count(text, tokenizer, 1024, 64)
        assert error > 0 and abs(got - exact) <= error + 0.01 * exact
    assert tokens.token_count(text[:1000], tokenizer) == (len(tokenizer.encode_ordinary(text[:1000])), 0.0)
    rows = spark.createDataFrame([(1, "one two"), (2, None), (3, ""), (4, "one two")], "id int, text string")
    got = {r.id: (r.n_bytes, r.kilobytes, r.tokens, r.tokens_error) for r in tokens.payload_sizes(rows, "text", PATH, PATTERN).collect()}
    assert got[1] == got[4] == (7, 0.0, 2, 0.0) and got[2] == got[3] == (0, 0.0, 0, 0.0)


def test_chunks_count_tokens_by_a_vocabulary(spark):
    docs = spark.createDataFrame([(1, "The harbour wall.\n\n" * 300, "text/plain"), (2, "a;b\n" + "1;2\n" * 10_001, "text/csv")], "id int, text string, kind string")
    got = chunk.chunked(docs, "text", docs["kind"], (PATH, PATTERN)).collect()
    tokenizer = tokens.vocabulary(PATH, PATTERN)
    first = [r for r in got if r.id == 1]
    assert len(first) > 1 and all(r.tokens == len(tokenizer.encode_ordinary(r.text)) and r.error is None for r in first)
    failed = [r for r in got if r.id == 2]
    assert len(failed) == 1 and failed[0].ordinal is None and "10000" in failed[0].error.replace(" ", "")


def test_deliveries_hold_one_slot_and_one_block_at_a_time(monkeypatch):
    """Events in any order, with times before the epoch and missing figures, fed in small blocks and due in three steps."""
    import pandas as pd

    class State(dict):
        getValue, updateValue, removeKey = dict.get, dict.__setitem__, dict.pop

    class Handle:
        def getMapState(self, *a):
            return State()

        def registerTimer(self, at):
            self.at = at

    class At:
        def __init__(self, at):
            self.getExpiryTimeInMs = self.getCurrentWatermarkInMs = lambda: at

    monkeypatch.setattr(deliveries, "BLOCK_ROWS", 50)
    held = deliveries.Deliveries(1000)
    held.init(Handle())
    sizes, by_time = [], deliveries._by_time
    monkeypatch.setattr(deliveries, "_by_time", lambda rows: sizes.append(len(rows)) or by_time(rows))
    rnd = random.Random(9)
    events = [(rnd.randint(-20_000, 200_000), 1, None if k % 3 else 2, k, rnd.choice([None, 7])) for k in range(3000)]
    neutral = list(deliveries._NEUTRAL[how] for how in deliveries.FOLDS.values())
    rows = [(at, *(n if f is None else f for f, n in zip(fs, neutral, strict=True)), sum(1 << k for k, f in enumerate(fs) if f is not None)) for at, *fs in events]
    frames = [pd.DataFrame(rows[k : k + 20], columns=list(deliveries._COLUMNS)) for k in range(0, 3000, 20)]
    assert list(held.handleInputRows(("e", None), iter(frames), None)) == []
    got = [f for at in (50_000, 50_500, 10**9) for f in held.handleExpiredTimer(("e", None), At(at), At(at))]
    got = [tuple(None if pd.isna(x) else x for x in r) for r in pd.concat(got).itertuples(index=False)]
    want = expected([("e", None, timedelta(milliseconds=at), *fs) for at, *fs in events], timedelta(seconds=1))
    assert sorted(got, key=lambda r: r[2]) == sorted(((e, t, at // timedelta(milliseconds=1), *fs) for e, t, at, *fs in want), key=lambda r: r[2])
    assert not held.held and max(sizes) < 120
