"""Entities in every text, and ranges of many bounds."""

import random
from bisect import bisect_right

from pyspark.sql import functions as F

from tablewell.llm import exact, pii


def test_an_entity_in_every_text_gets_one_surrogate_by_either_way(spark):
    texts = [f"Write to harbour.desk@example.org about box {k}, says Mr. {'Otto' if k % 3 else 'Paul'} Brandt{'er' if k % 5 else ''}." for k in range(600)]
    df = spark.createDataFrame([*enumerate(texts), (600, None), (601, "")], "doc_id long, text string")
    told, joined = (sorted((r.doc_id, r.text, r.n) for r in pii.with_surrogates(df, "n", b"key", sent=sent).collect()) for sent in (pii.SENT, -1))
    assert told == joined and len(joined) == 602
    mails = {w for _, text, _ in joined[:600] for w in text.split() if "@" in w}
    assert len(mails) == 1 and "harbour.desk" not in next(iter(mails))


def test_ranges_are_found_in_two_steps(spark):
    rnd = random.Random(2)
    for n in (0, 1, 2, 3, 7, 100, 999):
        bounds = sorted(rnd.sample(range(-2000, 2000), n))
        got = spark.range(-2100, 2100, 7).select("id", exact._range_of(F.col("id"), bounds).alias("k")).collect()
        assert all(r.k == bisect_right(bounds, r.id) for r in got)


def test_fingerprints_with_and_without_shared_digests(spark, monkeypatch):
    rows = [(k, f"text {k // 2} ß {'Ａ' if k % 2 else 'a'}") for k in range(40)] + [(None, None), (None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    plain = {(r.doc_id, r.n_chars): r.fingerprint for r in exact.fingerprints(df).collect()}
    # all digests equal: every canonical text gets a number of its own within the one bucket
    monkeypatch.setattr(exact, "_digest", lambda canon: F.when(canon.isNotNull(), F.unhex(F.lit("00" * 16))))
    crowded = {(r.doc_id, r.n_chars): r.fingerprint for r in exact.fingerprints(df).collect()}
    assert plain.keys() == crowded.keys() and all("-" not in f for f in plain.values())
    pairs = lambda found: {(a, b) for a in found for b in found if found[a] == found[b]}
    assert pairs(plain) == pairs(crowded)
