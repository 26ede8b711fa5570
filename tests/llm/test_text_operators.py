"""Operators 1 to 10 against brute force on small tables with every odd case."""

import hashlib
import itertools
import random
import re
import time
import unicodedata
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer
from xxhash import xxh64_intdigest

from tablewell.llm import bpe, exact, packing, pii, quality, rules, secrets, simhash, suffix_dedup, toxicity


def sha(data):
    return hashlib.sha256(data).hexdigest()


def key(x):
    return tuple((v is None, v) for v in x)


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=key)


# 8: suffix-array dedup


def removed(rows):
    first = {}
    size = suffix_dedup.WINDOW
    order = lambda d: float("inf") if d is None else d
    texts = [(order(r[0]), (r[1] or "").encode()) for r in rows]
    for d, b in texts:
        for k in range(len(b) - size + 1):
            w = b[k : k + size]
            first[w] = min(first.get(w, d), d)
    out = []
    for d, b in texts:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - size + 1):
            if first[b[k : k + size]] < d:
                gone[k : k + size] = True
        out.append((b, gone))
    return out


def test_op8_spans(docs, rows, none):
    want = []
    for r, (b, gone) in zip(rows, removed(rows), strict=True):
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        want.append((r[0], len(b), int(gone.sum()), spans, sha(bytes(x for x, g in zip(b, gone, strict=True) if not g))))
    for most_bytes in (suffix_dedup.BATCH_BYTES, 20_000):
        assert collected(suffix_dedup.removed_spans(docs, most_bytes)) == sorted(want, key=key)
    assert suffix_dedup.removed_spans(none).count() == 0


def test_op8_kept_text_has_whole_characters_and_all_columns(spark, rows):
    shared = "é" * 40
    own = [(1, "x" * 60 + shared, 7), (2, "yé" + shared + "é", 8), (3, None, 9)]
    df = spark.createDataFrame(own, "doc_id long, text string, part int")
    got = {r.doc_id: r for r in suffix_dedup.without_repeats(df).collect()}
    assert got[2].text == "y" and got[1].text == own[0][1] and got[3].text is None and got[3].part == 9


# 10: SimHash


def brute_print(text):
    parts = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not parts:
        return 0
    n = min(4, len(parts))
    hashes = [xxh64_intdigest(b" ".join(parts[k : k + n]), 42) for k in range(len(parts) - n + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, prints, distance=4):
    parent = list(range(len(ids)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance:
                parent[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [least.get(find(i)) for i in range(len(ids))]


def test_op10_components(docs, rows, none):
    prints = [brute_print(r[1]) for r in rows]
    want = [(r[0], f"{p:016x}", c) for r, p, c in zip(rows, prints, brute_components([r[0] for r in rows], prints), strict=True)]
    assert collected(simhash.near_duplicate_components(docs)) == sorted(want, key=key)
    assert simhash.near_duplicate_components(none).count() == 0


@pytest.mark.parametrize("most", [simhash.MOST, 8])
def test_op10_links_span_all_components(spark, most):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 30, dtype=np.uint64)
    marks = set(base.tolist())
    for b in base[:6].tolist():
        for _ in range(40):
            marks.add(b ^ sum(1 << int(k) for k in rng.choice(64, rng.integers(1, 6), replace=False)))
    marks = sorted(marks)
    signed = [(m - 2**64 if m >= 2**63 else m,) for m in marks]
    got = {r.mark: r.root for r in simhash.roots(spark.createDataFrame(signed, "mark long"), most=most).collect()}
    want = brute_components(list(range(len(marks))), marks)
    groups = {}
    for (m,), c in zip(signed, want, strict=True):
        groups.setdefault(c, []).append(m)
    for members in groups.values():
        assert len({got.get(m, m) for m in members}) == 1
        assert (len(members) > 1) == (members[0] in got)


def test_op10_one_of_each(docs, rows):
    prints = [brute_print(r[1]) for r in rows]
    want = len(set(zip(brute_components(list(range(len(rows))), prints), strict=True)))
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns and kept.count() == want


# 1: packing


def test_op1_pieces_and_sequences(docs, rows, none):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert any(2 < len(t.encode(r[1], add_special_tokens=False).ids) and "<|endoftext|>" in r[1] for r in rows if r[1])
    want = []
    for r in rows:
        ids = np.array([*t.encode(r[1] or "", add_special_tokens=False).ids, 2], "<u4")
        n = len(ids)
        first = n if n <= 1024 else n % 1024 or 1024
        cuts = [(0, first)] + [(s, 1024) for s in range(first, n, 1024)]
        want += [(r[0], k, s, m, zlib.crc32(ids[s : s + m].tobytes())) for k, (s, m) in enumerate(cuts)]
    got = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json")).collect()
    assert sorted((tuple(g)[:5] for g in got), key=key) == sorted(want, key=key)
    places = {}
    for g in got:
        places.setdefault(g.sequence_id, []).append((g.offset, g.length))
    for members in places.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(places) <= -(-sum(w[3] for w in want) // 1024) + 1
    assert packing.pack(none, public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def test_op1_encoder_agrees_with_the_tokenizer_on_odd_spaces():
    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    assert t.encode("a <|endoftext|> b", add_special_tokens=False).ids == [64, 220, 50256, 275]
    texts = ["a <|endoftext|> b", "<|endoftext|><|endoftext|>", "<|endoftext", " <|endoftext|>  x", "", " ", "a  b", " lead", "trail ", "a \nb", "x\n y", "one", "tab\tx y", "é à  ", "it's we'll 12 345", "a  b", "日本 語 <|endoftext|> x"]
    got = packing._Encoder(path).batch(texts)
    assert got == [np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts]


def test_op1_vocabularies_are_checked_in_full(tmp_path):
    import json

    path = public_tokenizers.path("byte_bpe_50k.json")
    packing.check_vocabulary(path)
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    merges = spec["model"]["merges"]
    merges[400], merges[20_000] = merges[20_000], merges[400]
    (tmp_path / "other.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError, match="order of ids"):
        packing.check_vocabulary(str(tmp_path / "other.json"))


def test_op1_crossover_keeps_every_item_once():
    import random

    rng = random.Random(1)
    lengths = [rng.randrange(1, 1024) for _ in range(300)]
    a = packing.best_fit(lengths, sorted(range(300), key=lambda i: -lengths[i]), [], 1024)
    b = packing.best_fit(lengths, list(range(300)), [], 1024)
    c = packing.crossover(lengths, a, b, 1024, rng)
    assert sorted(i for m in c for i in m) == list(range(300)) and all(sum(lengths[i] for i in m) <= 1024 for m in c)
    assert len(packing.evolve(lengths, 1024, 3, [b])) <= len(b)


def triplets(n, room, rng):
    """Items that fill n bins exactly, three in each."""
    out = []
    for _ in range(n):
        a = rng.randrange(room * 38 // 100, room * 49 // 100)
        b = min(rng.randrange((room - a) // 2, room // 2), room - a - room // 4)
        out += [a, b, room - a - b]
    rng.shuffle(out)
    return out


def test_op1_crossover_finds_what_best_fit_does_not():
    won = 0
    for seed in range(6):
        lengths = triplets(30 + 10 * (seed % 3), 1024, random.Random(seed))
        decreasing = packing.best_fit(lengths, sorted(range(len(lengths)), key=lambda i: -lengths[i]), [], 1024)
        best = packing.evolve(lengths, 1024, seed, [])
        without = packing.evolve(lengths, 1024, seed, [], work=0)
        assert sorted(i for b in best for i in b) == list(range(len(lengths)))
        assert all(sum(lengths[i] for i in b) <= 1024 for b in best)
        assert len(best) <= len(without) <= len(decreasing)
        again = packing.evolve(lengths, 1024, seed + 100, [best, decreasing])
        assert len(again) <= len(best)
        won += len(best) < min(len(without), len(decreasing))
    assert won >= 5


def test_op1_bound_is_below_every_packing():
    rng = random.Random(2)
    for _ in range(200):
        room = rng.randrange(4, 40)
        lengths = [rng.randrange(1, room + 1) for _ in range(rng.randrange(1, 9))]
        best = min(len(packing.best_fit(lengths, order, [], room)) for order in itertools.permutations(range(len(lengths)))) if len(lengths) < 7 else None
        least = packing.least_bins(lengths, room)
        assert -(-sum(lengths) // room) <= least
        if best is not None:
            assert least <= best
    assert packing.least_bins([600] * 5, 1024) == 5 and packing.least_bins([], 10) == 0



# 3: fingerprints


def brute_canonical(text):
    return re.sub(r"\s+", " ", unicodedata.normalize("NFKC", text).upper().lower()).strip()


def test_op3_fingerprints(docs, rows, none):
    got = exact.fingerprints(docs).collect()
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    bucket = lambda r: signed(xxh64_intdigest((r[1] or "").encode(), 42)) % exact.NULL_RANGES if r[0] is None else 0
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), bucket(r), r[1] or ""))
    texts = [r[1] or "" for r in order]
    after = texts[1:] + texts[:1]
    edits = [t[: len(t) - len(t) // 3] + n[: len(t) // 3] for t, n in zip(texts, after, strict=True)]
    assert sorted(((g.doc_id, g.n_chars, g.edited_sha256) for g in got), key=key) == sorted(((r[0], len(t), sha(e.encode())) for r, t, e in zip(order, texts, edits, strict=True)), key=key)
    by_edit = {(g.doc_id, g.edited_sha256): g for g in got}
    prints = {}
    for r, t, e, n in zip(order, texts, edits, after, strict=True):
        g = by_edit[r[0], sha(e.encode())]
        for text, mark in ((t, g.fingerprint), (e, g.edited_fingerprint)):
            assert prints.setdefault(brute_canonical(text), mark) == mark
        assert g.near_edited == float(brute_canonical(t) == brute_canonical(e)) and g.near_next == float(brute_canonical(t) == brute_canonical(n))
    assert len(set(prints.values())) == len(prints)
    assert exact.fingerprints(none).count() == 0


# 5: secrets


def brute_base(text):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    out = [(m.start(), 0, "assign", m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return [f"{k}:{a}:{b}" for a, _, k, b in sorted(out)]


def brute_entropy(text, base):
    spans = [tuple(map(int, s.split(":")[1:])) for s in base]
    out = []
    found = [(m.start(), m[0]) for m in re.finditer(secrets.CANDIDATE, text)]
    found = [c for at, v in found for c in ([(at + p.start(), p[0]) for p in re.finditer(secrets.PART, v) if not re.search(secrets.WORDS, p[0])] if re.search(secrets.WORDS, v) else [(at, v)])]
    for at, v in found:
        if any(re.search(a, v) for a in secrets.ALLOWED):
            continue
        limit = next(bits for _, p, bits in secrets.CLASSES if re.search(p, v))
        hot = []
        for k in range(len(v) - secrets.SPAN + 1):
            counts = np.array(list(Counter(v[k : k + secrets.SPAN]).values()))
            if np.log2(secrets.SPAN) - (counts * np.log2(counts)).sum() / secrets.SPAN >= limit - 1e-9:
                if hot and hot[-1][1] >= k:
                    hot[-1][1] = k + secrets.SPAN
                else:
                    hot.append([k, k + secrets.SPAN])
        out += [f"entropy:{at + a}:{at + b}" for a, b in hot if not any(x <= at + a and at + b <= y for x, y in spans)]
    return out


def brute_secrets(text):
    base = brute_base(text)
    every = sorted([*base, *brute_entropy(text, base)], key=lambda s: (int(s.split(":")[1]), ["assign", "access", "hex", "entropy"].index(s.split(":")[0])))
    return base, every


def brute_redacted(text, every, label="[secret]"):
    out, at = "", 0
    spans = sorted(tuple(map(int, s.split(":")[1:])) for s in every)
    whole = []
    for a, b in spans:
        if whole and whole[-1][1] >= a:
            whole[-1][1] = max(whole[-1][1], b)
        else:
            whole.append([a, b])
    for a, b in whole:
        out, at = out + text[at:a] + label, b
    return out + text[at:]


def test_op5_spans(docs, rows, none):
    want = []
    for r in rows:
        base, every = brute_secrets(r[1] or "")
        n = [sum(s.startswith(k) for s in base) for k in ("assign", "access", "hex")]
        want.append((r[0], *n, sha(",".join(base).encode()), ",".join(every)))
    assert any("entropy" in w[5] for w in want)
    assert collected(secrets.secret_spans(docs)) == sorted(want, key=key)
    assert secrets.secret_spans(none).count() == 0


def secret_texts():
    """Candidates of 5000 to 100 000 characters, many secrets in one text, and parts that the allow-list names."""
    rng = random.Random(8)
    run = lambda n, letters: "".join(rng.choice(letters) for _ in range(n))
    out = ["é " + run(n, secrets.ALPHABET) + " end" for n in (5000, 100_000, 20, 19, 275, 276, 531, 532)]
    out += [run(20_000, "0123456789abcdefABCDEF"), "".join(run(40, "ab1") + run(30, secrets.ALPHABET) for _ in range(300)), "a" * 50_000, "aB3" * 20_000]
    out.append("\n".join(f"token={run(12, 'abc123')} \U0001f600 {run(26, '0123456789abcdef')} {run(24, secrets.ALPHABET)} password : x{k}" for k in range(3000)))
    out += ["AKIA" + "QZ7R" * 5 + "/" + run(40, secrets.ALPHABET[:62]), "paths/example-" + run(30, secrets.ALPHABET[:62]) + "/more", "xxxx" + run(30, secrets.ALPHABET[:62]) + "-plain", "x" * 5000 + " y" * 5000]
    return out


def test_op5_long_candidates_and_many_spans(spark):
    texts = secret_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    began = time.perf_counter()
    spans = {r.doc_id: r.spans for r in secrets.secret_spans(docs).collect()}
    masked = {r.doc_id: r.text for r in secrets.redacted(docs).collect()}
    took = time.perf_counter() - began
    for k, text in enumerate(texts):
        _, every = brute_secrets(text)
        assert spans[k] == ",".join(every)
        assert masked[k] == brute_redacted(text, every)
    assert took < 60


def test_op5_redaction(docs, rows):
    got = secrets.redacted(docs)
    assert got.columns == docs.columns
    want = [None if r[1] is None else brute_redacted(r[1], brute_secrets(r[1])[1]) for r in rows]
    assert sorted((r.text for r in got.collect()), key=lambda t: (t is None, t)) == sorted(want, key=lambda t: (t is None, t))
    assert "key [secret]\" end" in want


# 6: rules


def brute_keeps(text):
    """Whether none of all rules fails, from the text."""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    n, chars = len(w), sum(map(len, w))
    runs = Counter(tuple(w[k : k + 8]) for k in range(n - 7))
    again = len({k + j for k in range(n - 7) if runs[tuple(w[k : k + 8])] > 1 for j in range(8)})
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    letters, upper = sum(c.isalpha() for c in text), sum(c.isupper() for c in text)
    failed = [
        n < 20, again > 0.3 * n, sum(c in "#*$%&|<>" for c in text) > 0.2 * n, len(lines) >= 4 and len(lines) - len(set(lines)) > 0.5 * len(lines), chars < 2 * n, chars > 15 * n,
        letters >= 20 and upper > 0.6 * letters, letters < 0.5 * chars, 50 <= n <= 2000 and len(set(w)) < 0.1 * n, sum(len(x.encode()) > 40 for x in w) > 0.2 * n,
        n >= 20 and sum(a == b for a, b in zip(w, w[1:], strict=False)) > 0.3 * n,
    ]
    return not any(failed)


def test_op6_measurements_and_ablation(docs, rows, none):
    want = []
    for r in rows:
        text = r[1] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        runs = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        cover = {k + j for k in range(len(w) - 7) if runs[tuple(w[k : k + 8])] > 1 for j in range(8)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        failed = len(w) < 20 or 100 * len(cover) > 30 * len(w)
        want.append((r[0], len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(cover), failed))
    ledger = rules.ledger(docs)
    base = rules.mask(rules.BASE)
    got = [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, bool(r.failed & base)) for r in ledger.collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    rng = random.Random(12)
    prose = [(9000 + k, " ".join(rng.choice("river town the bridge stone walks under slow cold light".split()) for _ in range(n)) + end) for k, (n, end) in enumerate([(25, ""), (25, " ### $$$ %%%"), (19, ""), (700, ""), (60, " " + "Z" * 900), (40, " ha" * 30)])]
    more = [(r[0], r[1]) for r in rows] + prose
    frame = rules.ledger(docs.sparkSession.createDataFrame(more, "doc_id long, text string")).withColumn("kept", rules.passes("2"))
    kept = sorted(((r.doc_id, bool(r.kept)) for r in frame.collect()), key=key)
    assert kept == sorted(((d, brute_keeps(text or "")) for d, text in more), key=key) and {k for _, k in kept} == {True, False}
    bits = [r.failed & rules.mask(rules.POLICIES["1"]) for r in ledger.collect()]
    for r in rules.ablation(ledger, "1").collect():
        bit = rules.mask((r.rule,))
        assert (r.n_failed, r.n_failed_alone, r.n_kept_without) == (sum(bool(b & bit) for b in bits), sum(b == bit for b in bits), sum(not b & ~bit for b in bits))
    assert rules.ledger(none).count() == 0


# 7: BPE


@pytest.mark.parametrize("chunk, overlap", [(bpe.CHUNK, bpe.OVERLAP), (600, 60), (90, 30)])
def test_op7_round_trip(docs, rows, none, chunk, overlap):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    e = bpe.encoding(path, public_tokenizers.PATTERN)
    assert isinstance(e, tiktoken.Encoding)
    want = []
    for r in rows:
        ids = np.array(e.encode_ordinary(r[1] or ""), "<u4")
        want.append((r[0], len(ids), sha(ids.tobytes()), sha((r[1] or "").encode())))
    assert collected(bpe.round_trip(docs, path, chunk=chunk, overlap=overlap)) == sorted(want, key=key)
    assert bpe.round_trip(none, path).count() == 0


def test_op7_one_very_long_text(spark):
    """A text of 6 MB, which is cut into many chunks, and one whose chunks never agree."""
    rng = random.Random(3)
    vocabulary = ["the", "river", "  ", "é", "日本語", "\n\n", "12345", "won't", "\U0001f600", ".", "\t", "x" * 40]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(1_000_000)), "z" * 100_000, "a b " * 9000]
    e = bpe.encoding(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    ids = [np.array(e.encode_ordinary(t), "<u4") for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = collected(bpe.round_trip(df, public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))
    assert got == [(k, len(x), sha(x.tobytes()), sha(t.encode())) for k, (t, x) in enumerate(zip(texts, ids, strict=True))]


# 2: PII


KEY = b"a key of the tests"


def test_op2_surrogates(docs, rows, none):
    out = pii.with_surrogates(docs, "n", KEY)
    assert out.columns == [*docs.columns, "n"]
    got = {r.row: r for r in out.collect() if r.row is not None}
    texts = {k: r.text for k, r in got.items()}
    mails = [re.findall(r"\S+@\S+", t)[0] for t in texts.values() if t and "@" in t]
    assert len(mails) == 2 and mails[0] == mails[1] and "anna" not in mails[0]
    phone = next(t for t in texts.values() if t and "call +1 (" in t)
    assert re.search(r"call \+1 \(\d{3}\) \d{3}-\d{4}$", phone) and "555-7713" not in phone
    name = next(r for r in got.values() if r.text and r.text.startswith("Mrs. "))
    given = re.match(r"Mrs\. (\w+) \w+ met Mr\. (\w+) \w+$", name.text)
    assert given[1] in pii.GIVEN["latin", "f"] and given[2] in pii.GIVEN["latin", "m"] and name.n == 2
    assert [r for r in texts.values() if r and "card" in r and "9807915762804490" in r] == []
    same = lambda r: not pii.find(r[1] or "")
    assert all(texts[r[7]] == r[1] for r in rows if r[7] is not None and same(r))
    assert pii.with_surrogates(none, "n", KEY).count() == 0
    with pytest.raises(ValueError, match="key"):
        pii.with_surrogates(docs, "n", b"")


def test_op2_permutations_are_one_to_one():
    seen = {pii.permuted_digits(b"k", "t", f"{n:04d}") for n in range(10000)}
    assert len(seen) == 10000
    right = [f"{k:015d}" for k in range(400)]
    cards = [d + str(c) for d in right for c in range(10)]
    made = [pii.surrogate(KEY, "card", c, 0) for c in cards]
    assert len(set(made)) == len(cards) and all((pii._luhn(c) == 0) == (pii._luhn(m) == 0) for c, m in zip(cards, made, strict=True))
    ibans = [f"DE{c:02d}{k:018d}" for k in range(20) for c in range(100)]
    made = [pii.surrogate(KEY, "iban", i, 0) for i in ibans]
    ok = lambda i: pii._right_check(i[:2], i[4:]) == i[2:4]
    assert len(set(made)) == len(ibans) and [ok(i) for i in ibans] == [ok(m) for m in made] and sum(map(ok, made)) == 20


def test_op2_mentions_of_a_person_agree(spark):
    texts = [
        "Dr. Xenia Schmidt wrote. Later Schmidt said that Xenia Schmidt's dog is fine.", "Mrs. Xenia Schmidt wrote", "Mr. Paul Meyer and Mr. MEYER", "Mr. Meyer's house; my name is Paul",
        "Paul Meyer came, no title", "г-жа Анна Иванова и Dr. Иванова", "Frau Quilla Kim, Herr Quilla Kim",
    ]
    got = [r.text for r in pii.with_surrogates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "n", KEY).orderBy("doc_id").collect()]
    given, family = re.match(r"Dr\. (\S+) (\S+) wrote", got[0]).groups()
    assert got[0] == f"Dr. {given} {family} wrote. Later {family} said that {given} {family}'s dog is fine." and got[1] == f"Mrs. {given} {family} wrote"
    assert given in pii.GIVEN["latin", "f"]
    paul, meyer = re.match(r"Mr\. (\S+) (\S+) and", got[2]).groups()
    assert got[2] == f"Mr. {paul} {meyer} and Mr. {meyer.upper()}" and got[3] == f"Mr. {meyer}'s house; my name is {paul}" and got[4] == f"{paul} {meyer} came, no title"
    assert paul in pii.GIVEN["latin", "m"] and len({family, meyer, "Schmidt", "Meyer"}) == 4
    anna, ivanova = re.match(r"г-жа (\S+) (\S+) и", got[5]).groups()
    assert anna in pii.GIVEN["cyrillic", "f"] and got[5].endswith(f"Dr. {ivanova}")
    quilla = re.findall(r"(?:Frau|Herr) (\S+) (\w+)", got[6])
    assert quilla[0] == quilla[1] and quilla[0][0] in pii.GIVEN["latin", "x"]


def many_entities():
    """A text for each of over 10 000 entities, of every kind, script, gender and title."""
    rng = random.Random(9)
    letters = {"latin": "abcdefghijklmnoprstuvz", "cyrillic": "абвгдежзиклмнопрст", "greek": "αβγδεζηθικλμνοπρσ"}
    word = lambda script: "".join(rng.choice(letters[script]) for _ in range(5)).capitalize()
    known = {s: [n for (t, _), names in pii.GIVEN.items() if t == s for n in names] for s in letters}
    out = []
    for k in range(4200):
        script = ("latin", "latin", "cyrillic", "greek")[k % 4]
        title = rng.choice(["Mr.", "Mrs.", "Dr.", "Herr", "Frau", "г-н", "г-жа"])
        given = rng.choice(known[script]) if k % 3 else word(script)
        out.append(f"{title} {given} {word(script)} here" if k % 5 else f"{title} {word(script)} here")
    for k in range(1200):
        account = "".join(rng.choice("0123456789") for _ in range(18))
        out += [f"u{k % 600}.x@mail{k % 7}.example.org", f"+1 ({k % 900 + 100}) 555-{1000 + k}", f"{k % 223 + 1}.{k % 256}.7.{k % 251}", f"ssn {100 + k % 800}-{k % 90 + 10}-{1000 + k}", f"card {4000000000000000 + 7919 * k}", f"DE{pii._right_check('DE', account) if k % 2 else '11'}{account} iban"]
    return list(enumerate(out))


def test_op2_ten_thousand_entities_stay_apart(spark):
    texts = many_entities()
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    table = pii.assigned(df, KEY).collect()
    entities = {(m.kind, m.form) for _, t in texts for m in pii.find(t)}
    assert {(r.kind, r.form) for r in table} == entities and len(table) == len(entities) > 10_000 and {r.kind for r in table} == {"given", "family", *pii.ONE_TO_ONE, "email"}
    space = lambda kind: "name" if kind in ("given", "family") else kind
    shown = {(space(r.kind), r.made.lower()) for r in table}
    assert len(shown) == len(table) and not shown & {(space(k), f.lower()) for k, f in entities}
    made = {(r.kind, r.form): r for r in table}
    told = {k: (r.attempt, r.gender) for k, r in made.items()}
    out = {r.doc_id: r.text for r in pii.with_surrogates(df, "n", KEY).collect()}
    for k, t in texts:
        assert out[k] == pii.replaced(t, KEY, told)[0] != t
        for m in pii.find(t):
            r = made[m.kind, m.form]
            assert pii.script_of(r.made) == pii.script_of(r.form)
            if r.kind == "given" and (r.gender or r.form in pii._GENDER):
                pool = pii.GIVEN[pii.script_of(r.form), pii._GENDER.get(r.form) or r.gender]
                assert all(x in pool for x in r.made.split("-"))


def test_op2_a_full_space_of_numbers_stays_one_to_one(spark):
    """Every number of a short format is real, so none can be avoided; nothing fails and all stay distinct."""
    texts = [(k, f"+1 {k:02d}-{j:02d}" ) for k in range(4) for j in range(3)]
    forms = {m.form for _, t in texts for m in pii.find(t)}
    df = spark.createDataFrame(texts, "doc_id long, text string")
    table = pii.assigned(df, KEY, tries=1).collect()
    assert {r.form for r in table} == forms and len({r.made for r in table}) == len(forms)


def test_op2_the_table_may_be_joined(spark):
    many = [(k, f"Mr. Paul Meyer{chr(97 + k % 26)}{chr(97 + k // 26)} wrote") for k in range(60)] + [(99, None), (None, "Mrs. Xenia Meyeraa")]
    df = spark.createDataFrame(many, "doc_id long, text string")
    a, b = (sorted((tuple(r) for r in pii.with_surrogates(df, "n", KEY, sent=sent).collect()), key=key) for sent in (pii.SENT, -1))
    assert a == b


# 9 and 4: classifiers


def labelled(spark, good, bad, n=160):
    rows = [(k, good(k) if k % 4 else bad(k)) for k in range(n)]
    labels = [(k, int(k % 4 > 0), int(k % 4 == 0)) for k in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_op9_learns_and_scores_whole_texts(spark, docs, none, monkeypatch):
    monkeypatch.setattr(quality, "EPOCHS", 25)
    df, labels = labelled(spark, lambda k: f"plain prose number {k} about the river and the town. " * 4, lambda k: f"%%% {k} $$$ ### &&& " * 12)
    net = quality.fit(df, labels)
    out = quality.with_scores(df, net, "p").collect()
    held = [r for r in out if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert all((r.p >= 0.3) == (r.doc_id % 4 > 0) for r in held)
    scored = quality.with_scores(docs, net, "p")
    assert scored.where("p is null or p < 0 or p > 1").count() == 0 and scored.count() == docs.count()
    assert quality.with_scores(none, net, "p").count() == 0
    prior = quality.fit(df, labels.where("quality = 1"))
    assert {round(r.p, 6) for r in quality.with_scores(docs, prior, "p").collect()} == {1.0}


def test_op9_training_sees_the_whole_of_long_texts(spark):
    """The labels differ only in a few words far inside texts of 40 000 bytes."""
    rng = random.Random(6)
    prose = lambda n: " ".join(rng.choice(["river", "town", "the", "bridge", "stone", "walks", "under", "slow"]) for _ in range(n))
    rows = [(k, prose(5000) + (" #@%$ &*!^ " if k % 2 else " mild calm ") + prose(1900)) for k in range(60)]
    labels = [(k, 1 - k % 2) for k in range(60)]
    net = quality.fit(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int"))
    out = quality.with_scores(spark.createDataFrame(rows, "doc_id long, text string"), net, "p").collect()
    held = [r for r in out if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(held) > 5 and all((r.p >= 0.5) == (r.doc_id % 2 == 0) for r in held)


def test_op9_gradient_steps_pool_as_scoring_does():
    """Half chunks of training against the scorer's chunks, for texts around every edge."""
    rng = np.random.default_rng(4)
    table = rng.normal(size=(quality.TAPS, 257, quality.FILTERS)).astype(np.float32)
    texts = [bytes(rng.integers(0, 256, n, dtype=np.uint8)) for n in (0, 1, 127, 128, 129, 255, 256, 257, 5000)]
    data, starts = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    peaks, seen, owner, many = quality._pooled_halves(table, data, starts, np.arange(len(texts)))
    half = quality.CHUNK // 2
    for k, t in enumerate(texts):
        padded = list(t) + [256] * (2 * quality.CHUNK)
        own = np.flatnonzero(owner == k)
        assert len(own) == many[k] == max(1, -(-len(t) // half))
        for j, row in enumerate(own):
            act = np.array([sum(table[i, padded[j * half + a + i]] for i in range(quality.TAPS)) for a in range(half)])
            assert np.allclose(peaks[row], act.max(0), atol=1e-4)
            assert np.allclose([sum(table[i, seen[row, c, i], c] for i in range(quality.TAPS)) for c in range(quality.FILTERS)], act.max(0), atol=1e-4)


def test_op9_the_sample_is_bounded_by_rows_and_bytes(spark):
    docs = spark.createDataFrame([(k, "é" * (k % 7 * 10)) for k in range(100)] + [(5, "other"), (6, None)], "doc_id long, text string")
    known = spark.createDataFrame([(k, k % 2) for k in range(80)] + [(3, 1)], "doc_id long, label int")
    few = quality.sampled(docs, known, 30, 1 << 40).collect()
    assert len(few) == len({r.doc_id for r in few}) == 30
    less = quality.sampled(docs, known, 30, 900).collect()
    assert 0 < sum(len(r.text.encode()) for r in less) <= 900 and {r.doc_id for r in less} < {r.doc_id for r in few}


def test_op9_score_is_that_of_all_chunks():
    rng = np.random.default_rng(2)
    net = quality.Network(rng.normal(size=(quality.TAPS, 257, quality.FILTERS)).astype(np.float32), rng.normal(size=quality.FILTERS).astype(np.float32), rng.normal(size=2 * quality.FILTERS) * 0.05, 0.1)
    texts = [bytes(rng.integers(0, 256, n, dtype=np.uint8)) for n in (0, 1, 127, 128, 129, 256, 257, 3000, 9000)]
    starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = quality.score_bytes(net, np.frombuffer(b"".join(texts), np.uint8), starts)
    for t, g in zip(texts, got, strict=True):
        half = quality.CHUNK // 2
        padded = list(t) + [256] * (2 * quality.CHUNK)
        n_half = max(1, -(-len(t) // half))
        act = np.array([sum(net.table[j, padded[k + j]] for j in range(quality.TAPS)) for k in range(n_half * half)])
        chunks = np.array([act[s : s + quality.CHUNK].max(0) for s in quality.chunk_starts(len(t))])
        pooled = np.maximum(chunks + net.bias, 0)
        z = np.concatenate([pooled.max(0), pooled.mean(0)]) @ net.weight + net.offset
        assert abs(g - 1 / (1 + np.exp(-z))) < 1e-4


def test_op4_learns_words_and_is_calibrated(spark, docs, none):
    df, labels = labelled(spark, lambda k: f"a calm text of {k} about rivers and towns", lambda k: f"you {k} are a zorgly fool and zorgish too", 400)
    model = toxicity.fit(df, labels)
    out = {r.doc_id: r.score for r in toxicity.toxicity_scores(df, model).collect()}
    held = [k for k in out if zlib.crc32(str(k).encode()) % 3 == 1]
    assert all((out[k] >= 0.7) == (k % 4 == 0) for k in held)
    assert any(w.startswith("zorg") for w in model.learned)
    assert toxicity.toxicity_scores(docs, model).where("score is null or score < 0 or score > 1").count() == 0
    assert toxicity.toxicity_scores(none, model).count() == 0
    assert toxicity.fit(df, labels.where("toxic = 2")).score(np.zeros((1, len(toxicity.FEATURES))))[0] < 1e-9


def brute_features(text, weights):
    """The features again, word by word, without what the operator does for speed."""
    text = text or ""
    words = re.findall(r"[^\W_]+", text.lower())
    weight = lambda w: max((weights[x] for x in [w, *(w[:k] + "-" for k in (4, 5, 6, 7) if len(w) > k)] if x in weights), default=None)
    bad = [k for k, w in enumerate(words) if w in toxicity.INSULTS]
    own = [k for k, w in enumerate(words) if weight(w) is not None]
    you = [k for k, w in enumerate(words) if w in toxicity.SECOND_PERSON]
    near = lambda some: sum(any(abs(k - j) <= toxicity.NEAR for j in you) for k in some)
    masked = [w for w in re.findall(r"[\w@$*!]+", text.lower()) for w in re.findall(r"\b(?=\w*[^\W\d_])(?=[\w@$*!]*[0-9@$*!])[\w@$*!]{3,}\w\b", w)]
    plain = [w.translate(toxicity.LOOKALIKES) for w in masked]
    letters, n, size, logs = sum(c.isalpha() for c in text), max(1, len(words)), max(1, len(text)), np.log(max(1, len(words)) + 2)
    upper = sum(c.isupper() for c in text)
    return [
        len(bad) / n, len(bad) / logs, len({words[k] for k in bad}), len(own) / n, len(own) / logs, len({words[k] for k in own}), sum(weight(words[k]) for k in own) / logs,
        len(you) / n, near(bad) / logs, upper / max(1, letters), sum(w.isupper() for w in text.split()) / n, text.count("!") / size, text.count("?") / size,
        sum(c in ".,;:-()\"'" for c in text) / size, sum(w in toxicity.INSULTS or weight(w) is not None for w in plain), len(masked) / n,
        len(re.findall(r"([^\W\d_])\1{2,}", text.lower())) / n, logs, max((weight(words[k]) for k in own), default=0.0), near(own) / logs,
    ]


def test_op4_features_and_scores_are_those_of_brute_force(spark, docs, rows):
    texts = [r[1] for r in rows] + ["YOU are an 1d10t!! you, zorgly, 3d fool... st00pid sooo f00l x@y", "idiot " * 20 + "you " + "calm " * 9 + "zorg zorgish you"]
    weights = {"zorg-": 2.5, "zorgly": 3.5, "calm": 2.1}
    lexicon = toxicity.Lexicon(weights)
    for t in texts:
        assert np.allclose(toxicity.features(t, lexicon), brute_features(t, weights))
    df, labels = labelled(spark, lambda k: f"a calm text of {k} about rivers and towns", lambda k: f"you {k} are a zorgly fool and zorgish too", 400)
    model = toxicity.fit(df, labels)
    scored = {}
    for r in toxicity.toxicity_scores(docs, model).collect():
        scored.setdefault(r.doc_id, []).append(r.score)
    for r in rows:
        x = brute_features(r[1], model.learned)
        margin = model.base
        for which, bound, leaf in model.splits:
            node = 0
            while node < len(which):
                node = 2 * node + (2 if x[which[node]] > bound[node] else 1)
            margin += leaf[node - len(which)]
        if not len(model.knots):
            continue
        k = np.searchsorted(model.knots, margin, "right")
        lo, hi = max(k - 1, 0), min(k, len(model.knots) - 1)
        share = 0 if model.knots[hi] == model.knots[lo] else min(1, max(0, (margin - model.knots[lo]) / (model.knots[hi] - model.knots[lo])))
        want = model.heights[lo] + share * (model.heights[hi] - model.heights[lo])
        assert any(abs(want - got) < 1e-9 for got in scored[r[0]])


def test_op4_calibration_rows_teach_no_words(spark):
    """A word that only texts of the calibration part hold isn't learned, however well it tells."""
    from pyspark.sql import functions as F

    many = spark.createDataFrame([(k, f"text {k} you are vile grolmy") for k in range(1200)], "doc_id long, text string")
    kept_apart = [tuple(r) for r in many.where(F.pmod(F.xxhash64("text", F.lit("split")), F.lit(4)) == 0).collect()]
    rows = kept_apart + [(2000 + k, f"text {k} " + ("you are vile" if k % 2 else "fair and calm")) for k in range(800)]
    labels = [(d, int("vile" in t)) for d, t in rows]
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert len(kept_apart) > 200 and "vile" in model.learned and len(model.knots) and not any(w.startswith("grol") for w in model.learned)


def test_op4_isotonic_is_monotone():
    rng = np.random.default_rng(1)
    m = rng.normal(size=300)
    knots, heights = toxicity.isotonic(m, (rng.random(300) < 1 / (1 + np.exp(-2 * m))).astype(float))
    assert (np.diff(heights) >= 0).all() and (np.diff(knots) >= 0).all()
