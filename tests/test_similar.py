"""Similarity joins against all pairs."""

import itertools
import random
from functools import partial

import numpy as np
import pytest

from tablewell.functions import likeness
from tablewell.operators import similar


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def jaro_winkler(a, b):
    """The definition, letter by letter."""
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    used, own = set(), []
    for i, c in enumerate(a):
        j = next((j for j in range(max(0, i - reach), min(len(b), i + reach + 1)) if j not in used and b[j] == c), None)
        if j is not None:
            used.add(j)
            own.append(c)
    if not own:
        return 0.0
    m, swaps = len(own), sum(x != b[j] for x, j in zip(own, sorted(used), strict=True)) // 2
    s = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    begin = len(list(itertools.takewhile(lambda p: p[0] == p[1], zip(a[:4], b[:4], strict=False))))
    return s + begin * 0.1 * (1 - s) if s > 0.7 else s


def words(seed, alphabet="abcdé", n=260, longest=11):
    rng = random.Random(seed)
    out = ["".join(rng.choices(alphabet, k=rng.randrange(0, longest))) for _ in range(n)]
    for w in rng.choices(out, k=n):
        k = rng.randrange(len(w) + 1)
        out.append(w[:k] + rng.choice(["", rng.choice(alphabet)]) + w[k + rng.randrange(2) :])
    return out


def test_many_pairs_at_once_are_as_each_alone(monkeypatch):
    a, b = words(1, n=400), words(2, n=400)
    for cells in (likeness.CELLS, 50):
        monkeypatch.setattr(likeness, "CELLS", cells)
        for most in range(4):
            assert likeness.edit_distances(a, b, most).tolist() == [min(distance(x, y), most + 1) for x, y in zip(a, b, strict=True)]
        assert np.allclose(likeness.jaro_winklers(a, b), [jaro_winkler(x, y) for x, y in zip(a, b, strict=True)])
    assert likeness.edit_distances([], [], 2).tolist() == [] and likeness.jaro_winklers([], []).tolist() == []
    assert likeness.edit_distances(["x" * 5000 + "y"], ["x" * 5000], 2).tolist() == [1]


def frame(spark, strings):
    return spark.createDataFrame([(s, k) for k, s in enumerate([*strings, None, strings[0], ""])], "word string, n int").repartition(3)


@pytest.mark.parametrize("most", [0, 1, 2, 3])
def test_all_pairs_within_a_distance(spark, most):
    strings = words(3, "abcdefghij", n=150, longest=14)
    own = sorted({*strings, ""})
    want = {(a, b, d) for a, b in itertools.combinations(own, 2) if (d := distance(a, b)) <= most}
    for q in (None, 2):
        assert {tuple(r) for r in similar.edit_pairs(frame(spark, strings), "word", most, q).collect()} == want


@pytest.mark.parametrize("least", [0.75, 0.9, 1.0])
def test_all_pairs_of_a_similarity(spark, least):
    strings = words(4, "abcdefghij", n=120)
    own = sorted({*strings, ""})
    want = {(a, b): s for a, b in itertools.combinations(own, 2) if (s := jaro_winkler(a, b)) >= least}
    got = {(r.a, r.b): r.likeness for r in similar.jaro_winkler_pairs(frame(spark, strings), "word", least).collect()}
    assert set(got) == set(want) and np.allclose([got[k] for k in want], list(want.values()))
    with pytest.raises(ValueError):
        similar.jaro_winkler_pairs(frame(spark, strings), "word", 0.6)


def test_a_crowded_key_is_split_and_loses_nothing(spark, monkeypatch):
    strings = [f"same{k:03d}" for k in range(120)]
    monkeypatch.setattr(similar, "CROWD", 7)
    want = {(a, b) for a, b in itertools.combinations(strings, 2) if distance(a, b) <= 1}
    got = similar.edit_pairs(spark.createDataFrame([(s,) for s in strings], "word string"), "word", 1)
    assert {(r.a, r.b) for r in got.collect()} == want


def test_only_candidates_are_compared(spark):
    rng = random.Random(9)
    strings = {"".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=12)) for _ in range(1500)}
    strings |= {s[:-1] + "0" for s in list(strings)[:50]}
    df = spark.createDataFrame([(s,) for s in strings], "s string")
    for keys, pieces, bound in ((similar.edit_keys(1, 3), partial(similar.grams, q=3), "abs(n_a - n_b) <= 1 AND abs(place_a - place_b) <= 1"), (similar.jaro_winkler_keys(0.95), similar.letters, "true")):
        n = similar._candidates(similar._keyed(df, pieces, keys), bound).count()
        assert 50 <= n < len(strings) ** 2 / 2 / 4, n
    plan = similar.edit_pairs(df, "s", 1)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_no_strings(spark):
    df = spark.createDataFrame([], "word string")
    assert similar.edit_pairs(df, "word", 2).count() == similar.jaro_winkler_pairs(df, "word", 0.9).count() == 0


def test_crowded_keys_and_few_remains(spark, monkeypatch):
    """Keys of over CROWD strings go to a join; words are found by deletions, so hardly a pair is compared in vain."""
    texts = words(9, n=300)
    df = spark.createDataFrame([(w,) for w in texts], "s string")
    wanted = {(a, b, distance(a, b)) for a, b in itertools.combinations(sorted(set(texts)), 2) if distance(a, b) <= 1}
    for crowd in (similar.CROWD, 2):
        monkeypatch.setattr(similar, "CROWD", crowd)
        assert {tuple(r) for r in similar.edit_pairs(df, "s", 1).collect()} == wanted
    keyed = similar._keyed(similar._strings(df, "s"), partial(similar.grams, q=4), similar.edit_keys(1, 4))
    assert dict(keyed.dtypes)["key"] == "bigint"
    assert similar._candidates(keyed, "abs(n_a - n_b) <= 1").count() <= 1.5 * len(wanted)
