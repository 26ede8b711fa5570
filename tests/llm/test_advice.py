"""What the findings of the first review asked for."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from test_text_operators import collected, key, removed

import corpus_pipeline
from tablewell.llm import simhash, suffix_dedup


def shingle_set(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    n = min(5, len(w))
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set()


def kept_ids(rows):
    """doc_ids of one of each component of shingle similarity 0.8 or more, by brute force."""
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted(least.values())


def near_rows():
    """Texts on their own, and copies in which more and more words differ: similarities from 0.99 down to 0.6."""
    rng = random.Random(11)
    fresh = lambda n: [f"w{rng.randrange(50000)}" for _ in range(n)]
    texts = [fresh(200) for _ in range(40)]
    for base in texts[:30]:
        for edits in (1, 3, 4, 5, 8):
            other = list(base)
            for k in range(edits):
                other[(k + 1) * 200 // (edits + 1)] = f"v{rng.randrange(50000)}"
            texts.append(other)
    for _ in range(60):
        other = list(texts[0])
        other[rng.randrange(200)] = f"u{rng.randrange(50000)}"
        texts.append(other)
    rows = [" ".join(t) for t in texts] + ["", " ", "a b", "A  b", "a b c"]
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_pipeline_near_dedup_is_that_of_similarity(spark):
    rows = near_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = kept_ids(rows)
    got = sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect())
    assert got == want


def test_large_groups_are_spanned_in_blocks(spark):
    rows = near_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marked = docs.mapInArrow(simhash._marks(1, "mark"), "doc_id long, text string, mark long")
    classes = docs.mapInArrow(simhash._sketches(5), "doc_id long, mark long, keys array<long>, sketch binary").dropDuplicates(["mark"])
    whole, large, cut = ({tuple(r) for r in simhash.components(simhash.similar_links(marked, classes, 5, 0.8, few, block)).collect()} for few, block in ((1000, 1000), (16, 2048), (2, 8)))
    assert whole == large == cut and whole


def hot_rows():
    """One passage in each of many texts, each in a context of its own; some contexts repeat."""
    rng = random.Random(4)
    own = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    passage, context = own(150), own(70)
    rows = [(k, own(70) + passage + own(70)) for k in range(300)]
    rows += [(k, context + passage + own(70)) for k in range(300, 340)]
    rng.shuffle(rows)
    return rows


def packed(rows, bid):
    batch = pa.record_batch({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows]})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as stream:
        stream.write_batch(batch)
    return suffix_dedup._row(batch.nbytes, "T", bid, None, zstandard.ZstdCompressor().compress(sink.getvalue()))


def test_op8_hot_prefixes_spread():
    """No task gets more than a small share of the strings at the ends of a hot passage."""
    parts, rows = 64, hot_rows()
    dealt = [r for b in suffix_dedup._arrays(parts, 0, 1)(iter([suffix_dedup._emit([packed(rows, 0)])])) for r in b.to_pylist()]
    marks = [r for b in suffix_dedup._sketches(parts, 0, 1)(iter([suffix_dedup._emit([packed(rows, 0)])])) for r in b.to_pylist()]
    told = [r for b in suffix_dedup._shared(iter([suffix_dedup._emit(marks)])) for r in b.to_pylist()]
    some = [r for b in suffix_dedup._arrays(parts, 0, 1, True)(iter([suffix_dedup._emit([*told, packed(rows, 0)])])) for r in b.to_pylist()]
    assert 0 < sum(r["bid"] for r in some if r["kind"] == "A") < sum(r["bid"] for r in dealt if r["kind"] == "A")
    found = [r for p in range(parts) for b in suffix_dedup._scan(parts)(iter([suffix_dedup._emit([r for r in dealt if r["part"] == p])])) for r in b.to_pylist()]
    load = np.zeros(parts)
    for r in found:
        if r["kind"] == "W":
            load[r["part"]] += len(suffix_dedup._string_rows_of(r)[0][0])
    assert load.sum() > 1000 and load.max() < 0.1 * load.sum()
    assert all(len(r["body"]) < 60_000 for r in dealt if r["kind"] == "A")


def test_op8_arrays_are_in_the_order_of_bytes():
    rows = hot_rows()
    (text,) = [packed(rows, 5)]
    data = "".join(t for _, t in rows).encode()
    for b in suffix_dedup._arrays(3, 0, 1)(iter([suffix_dedup._emit([text])])):
        for r in b.to_pylist():
            if r["kind"] == "A":
                family = suffix_dedup.IndexFamily()
                level = suffix_dedup._array_of(r, family)
                shown = [data[a + i : a + i + 16] for a, i in zip(level.at.tolist(), level.inside.tolist(), strict=True)]
                assert shown == sorted(shown) and len(shown) > 20
                assert all(family.text()[p : p + n + 49].tobytes() == data[a : a + n + 49] for p, a, n in zip(level.pos.tolist(), level.at.tolist(), level.n.tolist(), strict=True))


def test_op8_different_strings_of_one_digest_are_told_apart(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "_window_hash", lambda data, at, length: np.zeros(len(at), np.uint64))
    one, two = b"a" * 50, b"b" * 50
    text = np.frombuffer(one + two + one + two + two, np.uint8)
    z = np.zeros(5, np.int64)
    level = suffix_dedup.Level(k1=z, k2=z, check=z, doc=np.array([3, 1, 2, 2, 1]), origin=np.arange(5), at=z, n=z + 1, inside=z, pos=np.arange(5) * 50)
    told = {r["bid"] for b in suffix_dedup._ends(text, level, z) for r in b.to_pylist()}
    assert told == {0, 3}


@pytest.mark.parametrize("digest", [lambda data, at, length: np.zeros(len(at), np.uint64), lambda data, at, length: data[at].astype(np.uint64) % 3, suffix_dedup._window_hash])
def test_op8_hot_strings_of_one_digest_are_told_apart(monkeypatch, digest):
    """Whatever the digest, places go whose string has a smaller document, in their own batch or in another one."""
    monkeypatch.setattr(suffix_dedup, "_window_hash", digest)
    rng, dealt, gone, every = random.Random(4), [], set(), []
    for origin in range(6):
        kinds = [rng.randrange(9) for _ in range(40)]
        doc = np.array([rng.randrange(30) for _ in kinds])
        text = np.frombuffer(b"".join(bytes([65 + k]) * 49 + bytes([k % 2]) for k in kinds), np.uint8)
        z = np.zeros(40, np.int64)
        level = suffix_dedup.Level(k1=z, k2=z, check=z, doc=doc, origin=z + origin, at=50 * np.arange(40), n=z + 1, inside=z, pos=50 * np.arange(40))
        every += [(k, d, origin, 50 * i) for i, (k, d) in enumerate(zip(kinds, doc.tolist(), strict=True))]
        dealt += [r for b in suffix_dedup._hot_windows(4, text, level) for r in b.to_pylist()]
    dealt += [r for p in range(4) for b in suffix_dedup._scan_hot()(iter([suffix_dedup._emit([r for r in dealt if r["kind"] == "W" and r["part"] == p])])) for r in b.to_pylist()]
    for r in dealt:
        if r["kind"] == "F":
            gone |= {(r["bid"], at) for at in suffix_dedup._windows([r["body"]])[0].tolist()}
    least = {}
    for k, d, _, _ in every:
        least[k] = min(least.get(k, d), d)
    assert gone == {(o, at) for k, d, o, at in every if d > least[k]} and len(gone) > 100


@pytest.mark.parametrize("most_bytes", [suffix_dedup.BATCH_BYTES, 3000])
def test_op8_batches_added_later_give_the_same(spark, rows, tmp_path, most_bytes):
    """Each add is scanned against the stored levels; levels merge geometrically; an add that failed is done again."""
    every = [r[:2] for r in rows if len(r[1] or "") < 9000] + [(1000 + d, t) for d, t in hot_rows()[:150]] + [(500 - d, t) for d, t in hot_rows()[150:]]
    random.Random(2).shuffle(every)
    want = collected(suffix_dedup.removed_spans(spark.createDataFrame(every, "doc_id long, text string"), most_bytes))
    brute = [(r[0], len(b), int(gone.sum())) for r, (b, gone) in zip(every, removed(every), strict=True)]
    assert [w[:3] for w in want] == sorted(brute, key=key)
    family = suffix_dedup.SuffixFamily(spark, str(tmp_path / "family"), most_bytes)
    cuts = [0, 60, 90, 120, 300, len(every)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        family.add(spark.createDataFrame(every[a:b], "doc_id long, text string"))
    assert collected(family.removed_spans()) == want
    assert len(family.adds()) == 5 and len(family.levels()) < 5
    (tmp_path / "family" / "6" / "texts").mkdir(parents=True)
    assert len(family.adds()) == 5 and family.add(spark.createDataFrame(every[:40], "doc_id long, text string")) == 6
    got = {tuple(r) for r in family.removed_spans().collect()}
    assert set(want) <= got


def test_op8_hot_passage_leaves_all_but_its_first_text(spark):
    rows = hot_rows()
    want = [(r[0], len(b), int(gone.sum())) for r, (b, gone) in zip(rows, removed(rows), strict=True)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert collected(suffix_dedup.removed_spans(docs).select("doc_id", "n_bytes", "n_removed")) == sorted(want, key=key)


def test_survivors_of_equal_ids_are_always_the_same(spark):
    rows = [(1, "b c d e f", "x"), (1, "B C d e f", "y"), (1, "b c d e f", "a"), (None, "q r s t u", "z"), (None, "Q r s t u", "w"), (2, "b C d e f", None), (None, None, "k"), (None, "", None)]
    seen = set()
    for parts in (1, 3, 5):
        docs = spark.createDataFrame(rows, "doc_id long, text string, `root__` string").repartition(parts)
        for kept in (simhash.one_of_each(docs), simhash.one_of_each_similar(docs)):
            assert kept.columns == docs.columns
            got = collected(kept)
            assert len(got) == 3 and {(g[0], (g[1] or "").lower()) for g in got} == {(1, "b c d e f"), (None, "q r s t u"), (None, "")}
            seen.add(tuple(got))
    assert len(seen) == 1


def test_hot_keys_are_joined_apart_from_the_others(spark):
    from tablewell.llm.common import join_skewed

    big = spark.range(20_000).selectExpr("id", "if(id % 3 = 0, 7, id) as k")
    small = big.groupBy("k").count().selectExpr("k", "k * 2 as v", "`count` as n")
    got = join_skewed(big, small, "k", "n")
    assert got.columns == ["id", "k", "v"] and got.count() == 20_000 and got.where("v <> k * 2 or v is null").count() == 0
    assert "BroadcastHashJoin" in got._jdf.queryExecution().toString()


def test_near_dedup_takes_candidates_from_simhashes(spark, monkeypatch):
    """Without any key of min-wise hashes the links of SimHashes that are near, or equal, are still found."""
    rng = random.Random(8)
    base = [[rng.choice("abcdefghij") + str(rng.randint(0, 400)) for _ in range(400)] for _ in range(12)]
    rows = [(k, " ".join(b)) for k, b in enumerate(base)]
    rows += [(100 + k, " ".join(["x", *b[1:]])) for k, b in enumerate(base)] + [(500, base[0][0] + "  " + " ".join(base[0][1:])), (501, " "), (502, "")]
    near = [(r[0], s[0]) for r in rows[:12] for s in rows[12:24] if r[0] + 100 == s[0] and (simhash._bits(np.unique(simhash._hashes(simhash._tokens(r[1]), 2))) ^ simhash._bits(np.unique(simhash._hashes(simhash._tokens(s[1]), 2)))).bit_count() <= simhash.DISTANCE]
    assert len(near) > 8
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    seen = []
    monkeypatch.setattr(simhash, "similar_links", lambda docs, classes, *a, near, **k: seen.append((classes, near)) or near)
    simhash.one_of_each_similar(docs)
    least = {r.mark: r.least for r in seen[0][0].collect()}
    got = [tuple(sorted((least[r.a], least[r.b]))) for r in seen[0][1].collect()]
    assert len(got) == len(set(got)) and set(got) == set(near)
