"""Mapping, coercion, the two tiers, roll-ups and change feeds."""

import json
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from tablewell import names, paths
from tablewell.files import Folder
from tablewell.manifest import ColumnSpec, Conflict, FullText, Manifest
from tablewell.operators import feed, two_tier
from tablewell.operators.mapping import Field, rows_of
from tablewell.store import Gone, Store, retention_seconds


def field(name, kind, path=None, value=None, **more):
    return Field(ColumnSpec(name, kind, **more), path, value)


def docs(spark, *values):
    return spark.createDataFrame([(json.dumps(v),) for v in values], "json string")


def items(first, n):
    return {"items": [{"n": k, "kind": "error" if k % 3 == 0 else "info", "at": f"2026-01-01T00:00:{k % 60:02d}Z", "note": f"note {k}"} for k in range(first, first + n)]}


FIELDS = [field("n", "INTEGER", "$.n"), field("kind", "VARCHAR", "$.kind"), field("at", "TIMESTAMP", "$.at"), field("note", "VARCHAR", "$.note", embedded=True)]


class Clock:
    now = 1_000_000.0

    def __call__(self):
        return self.now


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"), Clock())


@pytest.mark.parametrize("text, steps", [("$.a.b[0]", ("a", "b", 0)), ('$["a b"]', ("a b",)), ("$$.x", ("x",)), ("$", ()), (r'$["q\"x"]', ('q"x',))])
def test_paths_are_read(text, steps):
    assert paths.parse(text).steps == steps and paths.parse(text).whole == text.startswith("$$")


@pytest.mark.parametrize("text", ["a", "$.", "$[x]", "$..a", "$[*].a"])
def test_bad_paths_are_refused(text):
    with pytest.raises(ValueError):
        paths.parse(text)


def test_missing_steps_and_wrong_containers_give_null(spark):
    got = rows_of(docs(spark, {"a": {"b": [1]}, "c": [1]}), "json", [field("x", "BIGINT", "$.a.b[0]"), field("y", "BIGINT", "$.a.z[3]"), field("z", "BIGINT", "$.c.k"), field("w", "BIGINT", "$.a[0]")])
    assert tuple(got.first()) == (1, None, None, None)


GOOD = [
    ("VARCHAR", 12, "12"), ("VARCHAR", True, "true"), ("VARCHAR", "x", "x"), ("INTEGER", "42", 42), ("INTEGER", 7.0, 7), ("BIGINT", 2**40, 2**40), ("DOUBLE", "1.5e3", 1500.0), ("DOUBLE", 2, 2.0),
    ("BOOLEAN", "true", True), ("BOOLEAN", 0, False), ("JSON", {"a": [1]}, '{"a":[1]}'), ("JSON", "s", '"s"'), ("INTEGER", None, None),
]


@pytest.mark.parametrize("kind, value, want", GOOD)
def test_coercion(spark, kind, value, want):
    assert rows_of(docs(spark, {"v": value}), "json", [field("v", kind, "$.v")]).first()[0] == want


@pytest.mark.parametrize("kind, value", [("VARCHAR", {"a": 1}), ("INTEGER", 1.5), ("INTEGER", 2**31), ("INTEGER", "x"), ("DOUBLE", "nope"), ("BOOLEAN", "TRUE"), ("BOOLEAN", "yes"), ("TIMESTAMP", "soon"), ("DATE", True)])
def test_coercion_refuses_and_names_the_column(spark, kind, value):
    with pytest.raises(Exception, match="column v: .* is no " + kind):
        rows_of(docs(spark, {"v": value}), "json", [field("v", kind, "$.v")]).collect()


def test_times_are_utc(spark):
    got = rows_of(docs(spark, {"a": "2026-01-02T03:04:05+02:00", "b": 0, "c": "2026-01-02T23:30:00-02:00"}), "json", [field("a", "TIMESTAMP", "$.a"), field("b", "TIMESTAMP", "$.b"), field("c", "DATE", "$.c")]).first()
    assert [str(x) for x in got] == ["2026-01-02 01:04:05", "1970-01-01 00:00:00", "2026-01-03"]


def test_rows_fan_out_with_constants_and_the_whole_document(spark):
    doc = {"number": 5, "files": [{"path": "a"}, {"path": "b"}]}
    got = rows_of(docs(spark, doc), "json", [field("pr", "INTEGER", "$$.number"), field("path", "VARCHAR", "$.path"), field("tag", "VARCHAR", value="t")], "$.files[*]", raw=True)
    assert sorted(map(tuple, got.collect())) == [(5, "a", "t", '{"path":"a"}'), (5, "b", "t", '{"path":"b"}')]
    with pytest.raises(Exception, match="may hold 1 rows"):
        rows_of(docs(spark, doc), "json", [field("path", "VARCHAR", "$.path")], "$.files[*]", most_rows=1).collect()


@pytest.mark.parametrize("name", ["1a", "_x", "a-b", "", "x" * 64])
def test_names_are_checked(name):
    with pytest.raises(ValueError):
        names.identifier(name)


def test_evolution_is_additive():
    m = Manifest.new("t", [ColumnSpec("a", "BIGINT", required=True)], ["a"])
    wide, added = m.evolved([ColumnSpec("a", "BIGINT"), ColumnSpec("b", "VARCHAR", required=True)])
    assert added == ["b"] and not wide.columns[1].required and Manifest.loads(wide.dumps()) == wide
    with pytest.raises(Conflict):
        m.evolved([ColumnSpec("a", "DOUBLE")])
    assert wide.evolved([ColumnSpec("b", "VARCHAR", embedded=True)])[0].embedded() == ["b"]
    with pytest.raises(ValueError):
        Manifest.new("t", [ColumnSpec("a", "BIGINT", embedded=True)])
    assert FullText(True).patched(stemmer="none", columns=None) == FullText(True, "none")


QUESTIONS = [
    "SELECT count(*) FROM v",
    "SELECT kind, count(*), max(at) FROM v GROUP BY kind ORDER BY kind",
    "SELECT n FROM v WHERE at >= '2026-01-01 00:00:20' AND kind LIKE 'err%' ORDER BY n",
    "SELECT a.n FROM v a JOIN v b ON a.n = b.n + 1 ORDER BY a.n DESC LIMIT 5",
    "SELECT count(DISTINCT _batch), count(DISTINCT _row_id) FROM v",
]


def answers(spark, store):
    store.view("events").createOrReplaceTempView("v")
    return [[tuple(r) for r in spark.sql(q).collect()] for q in QUESTIONS]


def test_answers_do_not_change_with_a_roll_up(spark, store):
    store.add("events", docs(spark, items(0, 40)), FIELDS, "$.items[*]")
    before = answers(spark, store)
    assert store.roll_up("events") and answers(spark, store) == before
    assert not store.roll_up("events") and store.manifest("events").generation == 1
    store.add("events", docs(spark, items(40, 10)), FIELDS, "$.items[*]")
    mixed = answers(spark, store)
    assert mixed[0] == [(50,)]
    store.roll_up("events")
    assert answers(spark, store) == mixed


def test_forgotten_rows_stay_forgotten(spark, store):
    store.add("events", docs(spark, items(0, 12)), FIELDS, "$.items[*]")
    store.roll_up("events")
    store.add("events", docs(spark, items(12, 6)), FIELDS, "$.items[*]")
    assert store.delete("events", "n % 2 = 0") == {"deleted": 9, "truncated": False}
    before = answers(spark, store)
    assert before[0] == [(9,)] and store.manifest("events").rows == 18
    store.roll_up("events")
    assert answers(spark, store) == before and store.manifest("events").rows == 9 and store.tombstones("events") is None


def test_rows_that_come_during_a_roll_up_stay_pending(spark, store, monkeypatch):
    store.add("events", docs(spark, items(0, 5)), FIELDS, "$.items[*]")
    real = two_tier.view

    def late(*args, **kwargs):
        monkeypatch.setattr(two_tier, "view", real)
        store.add("events", docs(spark, items(5, 3)), FIELDS, "$.items[*]")
        return real(*args, **kwargs)

    monkeypatch.setattr(two_tier, "view", late)
    store.roll_up("events")
    m = store.manifest("events")
    assert (m.base_rows, m.pending_rows, m.generation) == (5, 3, 1)
    assert store.view("events").count() == 8


def ints(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "n int")


N = [ColumnSpec("n", "INTEGER")]


def held(store):
    return sorted(r.n for r in store.view("t").collect())


def test_interleaved_writers_lose_nothing(spark, store, monkeypatch):
    """Each writer reads the same version, and puts its own after the other one did."""
    store.add_rows("t", ints(spark, 0), N)
    real, others = Folder.write_new, [1, 2, 3]

    def interrupted(self, name, text):
        if others and "/versions/" in name:
            other = others.pop()
            Store(spark, store.root, store.now).add_rows("t", ints(spark, other), [*N, ColumnSpec(f"c{other}", "BIGINT")])
        return real(self, name, text)

    monkeypatch.setattr(Folder, "write_new", interrupted)
    store.add_rows("t", ints(spark, 9), N)
    assert held(store) == [0, 1, 2, 3, 9]
    assert [c.name for c in store.manifest("t").columns] == ["n", "c1", "c2", "c3"] or len(store.manifest("t").columns) == 4
    seqs = [r["_seq"] for r in store.pending("t").collect()]
    assert len(set(seqs)) == 5


def test_writers_in_threads_lose_nothing(spark, store):
    with ThreadPoolExecutor(6) as pool:
        list(pool.map(lambda k: Store(spark, store.root, store.now).add_rows("t", ints(spark, 10 * k, 10 * k + 1), N), range(12)))
        assert held(store) == sorted(10 * k + j for k in range(12) for j in (0, 1))
        work = [pool.submit(Store(spark, store.root, store.now).add_rows, "t", ints(spark, 1000 + k), N) for k in range(6)]
        work.append(pool.submit(Store(spark, store.root, store.now).roll_up, "t"))
        work.append(pool.submit(Store(spark, store.root, store.now).forget, "t", store.view("t").where("n = 0").select("_row_id")))
        for w in work:
            w.result()
    want = sorted({10 * k + j for k in range(12) for j in (0, 1)} - {0} | {1000 + k for k in range(6)})
    assert held(store) == want
    store.roll_up("t")
    assert held(store) == want and store.manifest("t").rows == len(want)


def test_what_a_crash_leaves_is_not_seen(spark, store):
    store.add_rows("t", ints(spark, 1), N)
    # a version that was being written, a batch and a part that no version names
    stream = store.folder._fs.create(store.folder._path("t/versions/.000000000003.json.x"), True)
    stream.write(bytearray(b"{"))
    stream.close()
    ints(spark, 7).write.parquet(f"{store.root}/t/pending/orphan")
    ints(spark, 8).write.parquet(f"{store.root}/t/parts/orphan/rows")
    assert held(store) == [1]
    store.add_rows("t", ints(spark, 2), N)
    store.roll_up("t")
    assert held(store) == [1, 2]


def test_a_repeated_micro_batch_is_appended_once(spark, store):
    for number, value in ((0, 1), (1, 2), (1, 2), (0, 1), (2, 3)):
        store.add_rows("t", ints(spark, value), N, source=("stream", number))
        store.roll_up("t")
    store.add_rows("t", ints(spark, 4), N, source=("other", 0))
    assert held(store) == [1, 2, 3, 4]


def test_of_two_roll_ups_one_counts(spark, store, monkeypatch):
    store.add_rows("t", ints(spark, 1, 2), N)
    real = Folder.write_new

    def interrupted(self, name, text):
        monkeypatch.setattr(Folder, "write_new", real)
        Store(spark, store.root, store.now).roll_up("t")
        return real(self, name, text)

    monkeypatch.setattr(Folder, "write_new", interrupted)
    with pytest.raises(Conflict):
        store.roll_up("t")
    assert held(store) == [1, 2] and store.manifest("t").generation == 1


def test_roll_ups_rewrite_only_small_and_touched_parts(spark, store):
    put = lambda lo, hi: store.add_rows("t", spark.range(lo, hi).select(F.col("id").cast("int").alias("n")), N)
    put(0, 100)
    store.roll_up("t")
    put(100, 110)
    store.roll_up("t")
    large, small = store.manifest("t").parts
    assert (large.rows, small.rows) == (100, 10)
    put(110, 120)
    store.roll_up("t")
    assert store.manifest("t").parts[0] == large and store.manifest("t").parts[1].rows == 20
    store.forget("t", store.view("t").where("n = 105").select("_row_id"))
    store.roll_up("t")
    assert store.manifest("t").parts[0] == large and store.manifest("t").parts[1].rows == 19
    store.forget("t", store.view("t").where("n = 5").select("_row_id"))
    store.roll_up("t")
    assert [p.rows for p in store.manifest("t").parts] == [118]
    assert held(store) == [n for n in range(120) if n not in (5, 105)]
    assert store.generation("t", 1).count() == 100


def test_new_columns_are_null_in_old_rows(spark, store):
    store.add("events", docs(spark, items(0, 3)), FIELDS, "$.items[*]")
    store.roll_up("events")
    got = store.add("events", docs(spark, {"items": [{"n": 9, "extra": "x"}]}), [field("n", "INTEGER", "$.n"), field("extra", "VARCHAR", "$.extra")], "$.items[*]")
    assert got["added_columns"] == ["extra"]
    assert {r.n: r.extra for r in store.view("events").collect()} == {0: None, 1: None, 2: None, 9: "x"}
    assert store.view("events").where("extra IS NULL").count() == 3


def test_generations_are_kept_for_a_grace(spark, store):
    store.add("events", docs(spark, items(0, 2)), FIELDS, "$.items[*]")
    store.roll_up("events")
    store.add("events", docs(spark, items(2, 2)), FIELDS, "$.items[*]")
    store.roll_up("events")
    assert store.generation("events", 1).count() == 2 and store.reap() == 0
    store.now.now += 3601
    assert store.reap() == 1
    with pytest.raises(Gone):
        store.generation("events", 1)


def test_roll_ups_are_due_by_time_or_rows(spark, store):
    store.add("events", docs(spark, items(0, 2)), FIELDS, "$.items[*]")
    assert not store.due("events")
    store.now.now += 301
    assert store.roll_up_due() == ["events"] and not store.due("events")
    store.add_rows("events", spark.range(1000).select(F.col("id").cast("int").alias("n")), [ColumnSpec("n", "INTEGER")])
    assert store.due("events")


def test_change_feed_pages(spark, store):
    store.add("events", docs(spark, items(0, 5)), FIELDS, "$.items[*]")
    one = store.changes("events", limit=3)
    two = store.changes("events", after=one["next"], limit=3)
    assert [r.n for r in one["rows"] + two["rows"]] == [0, 1, 2, 3, 4] and two["next"] is None


def test_clones_are_apart(spark, store, tmp_path):
    store.add("events", docs(spark, items(0, 4)), FIELDS, "$.items[*]")
    other = store.clone(str(tmp_path / "other"))
    other.add("events", docs(spark, items(4, 1)), FIELDS, "$.items[*]")
    assert (store.view("events").count(), other.view("events").count()) == (4, 5)
    assert store.clone(str(tmp_path / "other")).view("events").count() == 5
    other.drop("events")
    assert other.tables() == [] and store.info()[0]["rows"] == 4


def test_vectors_survive_roll_ups_and_fresh_ones_win(spark, store):
    store.add("events", docs(spark, items(0, 3)), FIELDS, "$.items[*]")
    rows = store.view("events").select("_row_id", "n")
    vector = lambda x: rows.select("_row_id", F.lit("note").alias("column"), F.array(F.col("n").cast("float"), F.lit(x).cast("float")).alias("vector"))
    store.put_vectors("events", vector(1.0).where("vector[0] < 2"), "m", 2)
    store.roll_up("events")
    store.now.now += 1
    store.put_vectors("events", vector(5.0).where("vector[0] = 1"), "m", 2)
    got = {r.n: r.note_vec for r in store.view("events", vectors=True).collect()}
    assert got == {0: [0.0, 1.0], 1: [1.0, 5.0], 2: None}
    with pytest.raises(Conflict):
        store.put_vectors("events", vector(1.0), "other", 2)


def test_receipts_and_events(spark):
    m = Manifest.new("prs", [ColumnSpec("pr", "BIGINT"), ColumnSpec("path", "VARCHAR")], ["pr", "path"])
    r = feed.receipt(m, "b1", [{"pr": 1, "path": "it's"}, {"pr": 2, "path": None}])
    assert r["items"] == ["SELECT * FROM prs WHERE pr = 1 AND path = 'it''s'", "SELECT * FROM prs WHERE pr = 2 AND path IS NULL"]
    rows = [("operations.appended", "t", 2, 0, 5, None), ("operations.appended", "t", 3, 1, 9, None), ("table.rolled_up", "t", 5, 0, 9, 1)]
    got = feed.coalesced(spark.createDataFrame(rows, "event string, table string, rows long, tombstones long, seq long, previous_generation long"))
    assert sorted(tuple(x) for x in got.collect())[0] == ("operations.appended", "t", 5, 1, 9, None)


@pytest.mark.parametrize("text, seconds", [("90m", 5400), ("2w", 1209600)])
def test_retention(text, seconds):
    assert retention_seconds(text) == seconds


@pytest.mark.parametrize("text", ["0m", "521w", "5y", ""])
def test_bad_retention(text):
    with pytest.raises(ValueError):
        retention_seconds(text)


def test_plain_values_are_coerced_without_their_shape(spark):
    """What the text alone tells is decided first; every other value gets what it got before."""
    kinds = ["INTEGER", "BIGINT", "DOUBLE", "BOOLEAN", "VARCHAR"]
    for kind in kinds:
        plan = rows_of(docs(spark, {"v": 1}), "json", [field("v", kind, "$.v")])._jdf.queryExecution().analyzed().toString()
        assert plan.index("RLIKE") < plan.index("schema_of_variant")
    cases = [("VARCHAR", "", ""), ("VARCHAR", "[x", "[x"), ("VARCHAR", "{", "{"), ("VARCHAR", True, "true"), ("VARCHAR", 12, "12"), ("BIGINT", "007", 7), ("BIGINT", "-0", 0), ("BIGINT", 3.0, 3), ("BIGINT", 2**63 - 1, 2**63 - 1), ("INTEGER", 2**31 - 1, 2**31 - 1), ("BIGINT", None, None), ("DOUBLE", "1e3", 1000.0), ("DOUBLE", -0.1, -0.1), ("DOUBLE", 7, 7.0), ("BOOLEAN", "false", False), ("BOOLEAN", 1, True), ("BOOLEAN", True, True)]
    for kind in kinds:
        own = [c for c in cases if c[0] == kind]
        got = rows_of(docs(spark, *({"k": k, "v": v} for k, (_, v, _) in enumerate(own))), "json", [field("k", "INTEGER", "$.k"), field("v", kind, "$.v")]).collect()
        assert [r.v for r in sorted(got)] == [c[2] for c in own]
    for kind, value in [("DOUBLE", "1d"), ("DOUBLE", True), ("BIGINT", 3.5), ("BIGINT", True), ("INTEGER", 2**31), ("VARCHAR", {"a": 1}), ("VARCHAR", ["a"]), ("BOOLEAN", "TRUE")]:
        with pytest.raises(Exception, match="is no"):
            rows_of(docs(spark, {"v": value}), "json", [field("v", kind, "$.v")]).collect()
