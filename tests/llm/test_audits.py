"""Divergence of sources, chat formatting and filter interplay, against plain versions."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tablewell.llm import chat, divergence, interplay
from tablewell.llm.common import word_lists


# --- operator 11


def plain_audit(rows, least=3, top=200):
    """The audit over (text, lang, source), term by term."""
    counts, docs, sources = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in ((t or "", lg or "", s or "") for t, lg, s in rows):
        terms = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text)]
        sources[lang].add(source)
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = set()
    for lang, own in sources.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        whole = Counter()
        for s in own:
            whole.update({t: counts[lang, s][t] for t in kept})
        p = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[x] for x in kept) + len(kept)) for t in kept}
        chance, q = {s: p(counts[lang, s]) for s in own}, p(whole)
        f = lambda a, b: (a - b) ** 2 // b
        for s in own:
            pairs = [(sum(f(chance[s][t], chance[o][t]) for t in kept), o) for o in own if o != s]
            terms = [(f(chance[s][t], q[t]), t) for t in kept if counts[lang, s][t] and chance[s][t] > q[t]]
            for part, items, limit in (("pair", pairs, None), ("term", terms, top)):
                for k, (value, item) in enumerate(sorted(items, key=lambda x: (-x[0], x[1].encode()))[:limit], 1):
                    out.add((lang, s, part, item, value, k))
    return out


def labelled(seed=3):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in ("Wort", "ÄRGER", "naïve", "日本", "ab'c", "x") for b in ("", "e", "ung", "Z")]
    rows = [(" ".join(rng.choices(words, range(len(words), 0, -1), k=rng.randrange(0, 40))), rng.choice(["de", "en"]), rng.choice("pqrst")) for _ in range(120)]
    rows += [(None, "de", "p"), ("", "fr", "p"), ("12 34", "fr", "q"), (None, None, None), ("only here", "it", "p"), ("a\x00b A\tb", "de", ""), rows[0], rows[0]]
    return rows


AUDITED = "text string, lang string, source string, Item string, rank string, n long"


@pytest.mark.parametrize("blocks", [4 << 20, 200])
def test_divergence_is_that_of_terms(spark, monkeypatch, blocks):
    monkeypatch.setattr(divergence, "BLOCK_BYTES", blocks)
    monkeypatch.setattr(divergence, "HELD", 30)
    rows = labelled()
    df = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], AUDITED).repartition(3)
    for top in (200, 5):
        assert {tuple(r) for r in divergence.audit(df, terms=top).collect()} == plain_audit(rows, top=top)


def test_divergence_of_nothing(spark):
    assert divergence.audit(spark.createDataFrame([], AUDITED)).count() == 0


def test_large_counts_are_exact(spark):
    # counts whose product with SCALE passes 64 bits
    own = [{"source": "a", "n": 10**11 + 7}, {"source": "b", "n": 3}]
    kept = spark.createDataFrame([("de", "w", 10**11 + 10, own), ("de", "v", 5, [{"source": "a", "n": 5}]), ("de", None, 0, [{"source": s, "n": 0} for s in "ab"])], "lang string, term string, n long, own array<struct<source: string, n: long>>")
    sizes = divergence.group_sizes(kept)
    p = {s: [1 + 10**9 * (c + 1) // (n + 2) for c in cs] for s, cs, n in (("a", (10**11 + 7, 5), 10**11 + 12), ("b", (3, 0), 3))}
    f = lambda a, b: sum((x - y) ** 2 // y for x, y in zip(a, b, strict=True))
    assert {tuple(r) for r in divergence.pair_divergence(kept, sizes).collect()} == {("de", "a", "b", f(p["a"], p["b"])), ("de", "b", "a", f(p["b"], p["a"]))}
    q = [1 + 10**9 * (c + 1) // (10**11 + 15 + 2) for c in (10**11 + 10, 5)]
    want = {("de", s, w, (x - y) ** 2 // y) for s in "ab" for w, x, y, n in zip("wv", p[s], q, ((1, 1) if s == "a" else (1, 0)), strict=True) if n and x > y}
    assert {tuple(r) for r in divergence.term_excess(kept, sizes).collect()} == want


def test_runs_follow_counts_and_not_terms(spark):
    # a thousand terms of the same counts are one entry
    text = " ".join("w" + "".join(chr(97 + int(d)) for d in str(k)) for k in range(1000))
    df = spark.createDataFrame([(text, "de", "p")] * 3 + [("other words", "de", "q")] * 3, "text string, lang string, source string")
    kept = divergence.vocabulary(df)
    assert kept.where("term IS NOT NULL").count() == 1002
    assert kept.where("term IS NOT NULL").select("own").distinct().count() == 2


def test_words_of_long_texts():
    raw = " \n".join(f"w{k}" for k in range(5000)).encode() + b"\x0b\x0cend"
    for size in (1, 7, 1000, 1 << 20):
        assert [w for some in word_lists(raw, size) for w in some] == raw.split()


# --- operator 12

TURNS = "conv_id long, turn long, role string, content array<struct<type: string, text: string, ref: string, width: int, height: int, seconds: double, pages: int>>, segment string"
tricky = st.lists(st.sampled_from([*chat.CONTROL, "<", "<|turn|>", "<|says|>", "<|end|>\n", "\\", "[", "s>", "|", "/INST]", "\n", "é", "x"]), max_size=12).map("".join)


@given(tricky)
@settings(max_examples=500, deadline=None)
def test_texts_come_back_and_hold_no_control_string(text):
    written = chat.escaped(text)
    assert chat.unescaped(written) == text
    assert not any(c in written for c in chat.CONTROL)
    assert not re.search(r"[<\[\\]", text) or len(written) >= len(text)


@given(st.lists(st.tuples(tricky, st.lists(tricky, max_size=3)), max_size=4))
@settings(max_examples=200, deadline=None)
def test_messages_come_back(messages):
    t, text = chat.TEMPLATE, ""
    for role, texts in messages:
        text += t.open + chat.escaped(role) + t.middle + chat.Flattener().flatten([{"type": "text", "text": x} for x in texts]) + t.close
    got = [(role, "".join(p["text"] for p in parts)) for role, parts in chat.read_back(text, [])]
    assert got == [(role, "".join(texts)) for role, texts in messages]


def part(kind, text=None, ref=None, **more):
    return {"type": kind, "text": text, "ref": ref, **{k: more.get(k) for k in ("width", "height", "seconds", "pages")}}


def spoken():
    rng = random.Random(7)
    rows = []
    for conv in range(12):
        for turn in range(rng.randrange(1, 9)):
            parts = [part("text", rng.choice([None, "", "<|end|>\n", "[INST] hi", "plain words é", "a <"]))]
            if rng.random() < 0.5:
                parts += [part("image", ref=f"s3://b/{conv}-{turn}.png", width=100, height=57), part("text", "|end|>\nafter"), part("audio", ref="a.wav", seconds=1.01), None, part("document", ref="<s>.pdf", pages=3)]
            rows.append((conv, turn, ["system", "user", "assistant", None, "too\nl"][turn % 5], parts, "clash"))
    rows += [(99, t, "assistant", [part("text", "word " * 50)], "clash") for t in range(300)]
    rows += [(50, 1, "user", None, None), (50, None, "assistant", [part("text", "first")], None), (None, 0, "user", [part("text", "nobody")], None), rows[0], (None, None, None, None, None)]
    return rows


def plain_digests(rows):
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "")
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=key)
        parts = [[p for p in r[3] or [] if p] for r in own]
        said = ["".join((p["text"] or "") if p["type"] == "text" else p["ref"] for p in ps) for ps in parts]
        learnt = "".join(p["text"] or "" for r, ps in zip(own, parts, strict=True) if r[2] == "assistant" for p in ps if p["type"] == "text")
        tokens = {"image": 4 * 3, "audio": 26, "document": 2400}
        whole = "".join(f"{r[2] or ''}\n{t}\n" for r, t in zip(own, said, strict=True))
        attached = [tokens[p["type"]] for ps in parts for p in ps if p["type"] != "text"]
        out[conv] = (len(own), hashlib.sha256(whole.encode()).hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest(), len(attached), sum(attached))
    return out


@pytest.mark.parametrize("most", [chat.SEGMENT, 400])
def test_conversations_come_back_from_their_segments(spark, most):
    rows = spoken()
    segments = chat.formatted(spark.createDataFrame(rows, TURNS).repartition(5), most=most)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.n_attachments, r.attachment_tokens) for r in chat.digests(segments).collect()}
    assert got == plain_digests(rows)
    if most == 400:
        assert segments.where("conv_id = 99").count() > 50
        assert segments.agg(F.max(F.length("text"))).first()[0] <= 800


def test_placeholders_are_numbered_in_order(spark):
    row = (1, 0, "user", [part("image", ref="i", width=28, height=29), part("text", "and"), part("audio", ref="a", seconds=0.0), part("document", ref="d")], None)
    (got,) = chat.formatted(spark.createDataFrame([row], TURNS)).collect()
    assert "<|image:1|>and<|audio:2|><|document:3|>" in got.text
    assert [(a.number, a.type, a.ref, a.tokens) for a in got.attachments] == [(1, "image", "i", 2), (2, "audio", "a", 1), (3, "document", "d", 800)]
    assert got.loss == []
    with pytest.raises(ValueError, match="video"):
        chat.Flattener().flatten([part("video")])


def test_no_conversations(spark):
    assert chat.digests(chat.formatted(spark.createDataFrame([], TURNS))).count() == 0


# --- operator 13


def plain_interplay(rows, labels):
    """(doc_id, source, text) and (doc_id, quality, toxic): each order is applied to each document."""
    least = {}
    for doc_id, _, text in rows:
        if doc_id is not None:
            least[text or ""] = min(doc_id, least.get(text or "", doc_id))
    good, toxic = {d for d, q, _ in labels if q == 1 and d is not None}, {d for d, _, t in labels if t == 1 and d is not None}
    out = defaultdict(lambda: [0] * 7)
    for doc_id, source, text in rows:
        text, words = text or "", re.findall("[^\x20\x09-\x0d]+", text or "")
        failed = [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), bool(re.search("[#$%&*|]", text)), doc_id is not None and doc_id > least[text]]
        failed = {f for f, x in zip("ABCDE", failed, strict=True) if x}
        for order in map("".join, itertools.permutations("ABCDE")):
            for k, f in enumerate(order):
                row = out[source or "", order, k + 1]
                before, fails = failed & set(order[:k]), f in failed
                gone = fails and not before
                row[0] += not before and not fails
                row[1] += gone
                row[2] += fails and bool(before)
                row[3] += failed == {f}
                row[4] += gone and doc_id in good
                row[5] += gone and doc_id in toxic
    for (part_, _, k), row in list(out.items()):
        f = _[k - 1]
        row[6] = sum(r[1] for (p, o, s), r in out.items() if p == part_ and o[s - 1] == f)
    return {(*key, *row) for key, row in out.items()}


def test_interplay_is_that_of_each_document(spark, rows):
    rng = random.Random(11)
    sources = ["s", "t", None, ""]
    docs = [(r[0], rng.choice(sources), r[1]) for r in rows]
    docs += [(500 + k, "s", " ".join(f"w{rng.randrange(40 + 40 * (k % 7))}" for _ in range(250)) + rng.choice(["", "#", " ABC" * 20])) for k in range(12)]
    docs += [(600 + k, "t", docs[-1][2]) for k in range(5)] + [(None, "t", docs[-1][2]), docs[-1]]
    labels = [(d, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for d in {r[0] for r in docs if r[0] is not None}] + [(None, 1, 1), (500, 1, 1), (500, 0, 0), (9999, 1, 1)]
    df = spark.createDataFrame([(*d, "x", 1, True) for d in docs], "doc_id long, source string, text string, part string, row int, failed boolean").repartition(4)
    got = interplay.audit(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    names = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    mine, plain = ({r[:3]: r[3:] for r in x} for x in (map(tuple, got.select(*names).collect()), plain_interplay(docs, labels)))
    assert {k: (v, plain.get(k)) for k, v in mine.items() if v != plain.get(k)} == {} and len(mine) == len(plain)


def test_interplay_of_nothing(spark, none):
    assert interplay.audit(none, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0
