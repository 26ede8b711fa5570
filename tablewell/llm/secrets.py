"""Secret scans (operator 5), with DataFrame functions only.

Base kinds are found by pattern: `assign`, `access` and `hex`. The method adds the kind `entropy`: over each candidate
string (a run of `CANDIDATE`), a window of `SPAN` characters slides; the counts of its characters, and from them the sum of
n * log2(n), are kept by adding one character and removing one. The Shannon entropy of the window is compared with the
limit of the string's character class; the windows over the limit, merged, are the span.

Suppressed are candidates that an allow-list names, the parts of a candidate (between separators) that hold a word of
`WORDS`, and entropy spans that lie wholly in one base span.

The work is in proportion to a text's length (times a logarithm for its matches): long candidates are cut into blocks of
`BLOCK` characters that overlap by a window, counts are packed into `LONGS` numbers, positions come from running sums, and
texts are masked block by block.

Positions: matches are marked with a character that texts don't hold (where one does, it counts as a like character that no
pattern knows), texts are split there, and lengths are summed. Spans count code points and exclude their end.

Defined results: null text counts as empty and has no span; null doc_ids and further columns pass; repeated rows each get
their row; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, read_table

# The base patterns, the shortest match (of group 2 for assign) and the order of kinds.
PATTERNS = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
}
KINDS = (*PATTERNS, "entropy")
CANDIDATE = r"[A-Za-z0-9+/=_-]{20,}"
PART = r"[A-Za-z0-9]{20,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-"
SPAN = 20
# Character classes, the first that fits counts, and their limits in bits per character.
CLASSES = (("hexadecimal", "^[0-9A-Fa-f]+$", 3.0), ("letters and digits", "^[0-9A-Za-z]+$", 3.7), ("base64", "^[0-9A-Za-z+/=_-]+$", 3.9))
# Candidates that are no secrets: words without digits, numbers, rulers, dates, unique ids.
ALLOWED = (
    "^[A-Za-z+/=_-]+$",
    "^[0-9+/=_-]+$",
    r"^(.)\1+$",
    "^[0-9]{4}-[0-9]{2}-[0-9]{2}[0-9T_-]*$",
    "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
)
WORDS = "(?i)example|placeholder|changeme|xxxx"
MARK, OTHER = "\x01", "\x02"

BLOCK = 256
MASK_BLOCK = 4096
BITS, PER_LONG = 5, 12  # a count of up to SPAN takes 5 bits, 12 of them fit a number
LONGS = -(-len(ALPHABET) // PER_LONG)
SCALE = 1 << 40  # n * log2(n) in whole numbers, so that adding and removing is exact
WEIGHTS = [round(n * math.log2(n) * SCALE) if n > 1 else 0 for n in range(SPAN + 2)]


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once, however often it is named there."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _running(values: Column, plus: Callable[[Column, Column], Column]) -> Column:
    """Running totals of an array, by doubling steps: as many passes as the length has binary digits."""

    def step(now: Column, k: Column) -> Column:
        far = F.least(F.call_function("shiftleft", F.lit(1), k), F.size(now))
        before = F.concat(F.array_repeat(F.lit(None).cast("int"), far), F.slice(now, F.lit(1), F.size(now) - far))
        return F.zip_with(now, before, lambda a, b: F.when(b.isNull(), a).otherwise(plus(a, b)))

    steps = lambda v: F.sequence(F.lit(0), F.ceil(F.log2(F.size(v).cast("double"))).cast("int"))
    return _let(values, lambda v: F.when(F.size(v) < 2, v).otherwise(F.aggregate(steps(v), v, step)))


def _before(values: Column, first: Column) -> Column:
    """Each value's predecessor."""
    return F.when(F.size(values) == 0, values).otherwise(F.concat(F.array(first), F.slice(values, F.lit(1), F.size(values) - 1)))


def _found(text: Column, pattern: str) -> Column:
    """Array of (start, stop, value) of a pattern's matches."""
    marked = F.split(F.regexp_replace(text, f"(?:{pattern})", f"{MARK}$0{MARK}"), MARK)

    def placed(parts: Column) -> Column:
        stops = _running(F.transform(parts, lambda p: F.length(p)), lambda a, b: a + b)
        each = F.zip_with(parts, stops, lambda p, e: F.struct((e - F.length(p)).alias("start"), e.alias("stop"), p.alias("value")))
        return F.filter(each, lambda s, k: k % 2 == 1)

    none = F.array().cast("array<struct<start:int,stop:int,value:string>>")
    return _let(marked, lambda parts: F.when(F.size(parts) > 1, placed(parts)).otherwise(none))


def _span(start: Column, kind: str, stop: Column) -> Column:
    """A span; as a struct it sorts by start and by the order of kinds."""
    return F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("rank"), stop.alias("stop"))


def _base(text: Column, kind: str) -> Column:
    pattern, group, least = PATTERNS[kind]
    value = lambda s: F.regexp_extract(s["value"], pattern, group) if group else s["value"]
    return F.transform(F.filter(_found(text, pattern), lambda s: F.length(value(s)) >= least), lambda s: _span(s["start"], kind, s["stop"]))


def merged(spans: Column) -> Column:
    """Spans (start, stop), sorted by start, with those that touch or overlap made one."""

    def join(s: Column) -> Column:
        reach = _running(F.transform(s, lambda x: x["stop"]), lambda a, b: F.greatest(a, b))

        def cut(r: Column) -> Column:
            opens = F.zip_with(s, _before(r, F.lit(-1)), lambda x, b: F.when(x["start"] > b, x["start"]))
            after = F.concat(F.slice(F.transform(s, lambda x: x["start"]), F.lit(2), F.size(s)), F.array(F.lit(2**31 - 1)))
            closes = F.zip_with(r, after, lambda stop, start: F.when(start > stop, stop))
            return F.zip_with(F.filter(opens, lambda x: x.isNotNull()), F.filter(closes, lambda x: x.isNotNull()), lambda a, b: F.struct(a.alias("start"), b.alias("stop")))

        return _let(reach, cut)

    none = F.array().cast("array<struct<start:int,stop:int>>")
    return _let(spans, lambda s: F.when(F.size(s) == 0, none).otherwise(join(s)))


def _place(code: Column) -> Column:
    """Where the count of a character is packed (-1: no character)."""
    return F.struct(F.floor(code / PER_LONG).cast("int").alias("slot"), (code % PER_LONG * BITS).cast("int").alias("shift"))


def _block_runs(steps: Column, most: Column) -> Column:
    """Merged runs (start, stop) of the windows of one block whose sum is at most `most`, by incremental counts; `steps`
    holds the places of each character and of the one that leaves."""
    none = F.array().cast("array<struct<start:int,stop:int>>")
    count = lambda counts, at: F.call_function("shiftright", F.get(counts, at["slot"]), at["shift"]).bitwiseAND(31).cast("int")
    weights = F.array(*(F.lit(b - a) for a, b in zip(WEIGHTS, WEIGHTS[1:], strict=False)))
    start = F.struct(
        F.array_repeat(F.lit(0).cast("long"), LONGS).alias("counts"), F.lit(0).cast("long").alias("sum"), F.lit(0).alias("n"),
        F.lit(-1).alias("start"), F.lit(-1).alias("stop"), none.alias("runs"),
    )

    def changed(counts: Column, at: Column, by: int) -> Column:
        return F.transform(counts, lambda c, k: F.when(k == at["slot"], c + F.call_function("shiftleft", F.lit(by).cast("long"), at["shift"])).otherwise(c))

    def removed(state: Column, old: Column) -> Column:
        gone = F.struct(changed(state["counts"], old, -1).alias("counts"), (state["sum"] - F.get(weights, count(state["counts"], old) - 1)).alias("sum"))
        return F.when(old["slot"] < 0, F.struct(state["counts"].alias("counts"), state["sum"].alias("sum"))).otherwise(gone)

    def step(state: Column, at: Column) -> Column:
        def entered(left: Column) -> Column:
            total, n = left["sum"] + F.get(weights, count(left["counts"], at["new"])), state["n"] + 1
            hot = (n >= SPAN) & (total <= most)
            apart = hot & (n - SPAN > state["stop"])
            close = F.array(F.struct(state["start"].alias("start"), state["stop"].alias("stop")))
            return F.struct(
                changed(left["counts"], at["new"], 1).alias("counts"), total.alias("sum"), n.alias("n"),
                F.when(apart, n - SPAN).otherwise(state["start"]).alias("start"), F.when(hot, n).otherwise(state["stop"]).alias("stop"),
                F.when(apart & (state["stop"] >= 0), F.concat(state["runs"], close)).otherwise(state["runs"]).alias("runs"),
            )

        return _let(removed(state, at["old"]), entered)

    last = lambda s: F.when(s["stop"] < 0, s["runs"]).otherwise(F.concat(s["runs"], F.array(F.struct(s["start"].alias("start"), s["stop"].alias("stop")))))
    return F.aggregate(steps, start, step, last)


def windows_over(value: Column, limit: Column) -> Column:
    """Merged runs (start, stop) of the windows of `value` whose entropy is at least `limit`."""
    most = ((F.lit(math.log2(SPAN)) - limit) * float(SPAN * SCALE) + 0.5).cast("long")
    codes = F.transform(F.split(value, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)

    def in_block(codes: Column, most: Column, k: Column) -> Column:
        def shifted(own: Column) -> Column:
            old = F.concat(F.array_repeat(F.lit(-1), SPAN), own)
            both = F.zip_with(own, F.slice(old, F.lit(1), F.size(own)), lambda n, o: F.struct(_place(n).alias("new"), _place(o).alias("old")))
            return F.transform(_block_runs(both, most), lambda r: F.struct((r["start"] + k * BLOCK).alias("start"), (r["stop"] + k * BLOCK).alias("stop")))

        return _let(F.slice(codes, k * BLOCK + 1, F.lit(BLOCK + SPAN - 1)), shifted)

    blocks = lambda c: F.sequence(F.lit(0), F.floor((F.size(c) - SPAN) / BLOCK).cast("int"))
    # the limit is computed once for a candidate, not for each of its characters
    return _let(most, lambda m: _let(codes, lambda c: merged(F.flatten(F.transform(blocks(c), lambda k: in_block(c, m, k))))))


def _entropy(text: Column) -> Column:
    limit = lambda v: F.coalesce(*(F.when(v.rlike(pattern), F.lit(bits)) for _, pattern, bits in CLASSES))
    allowed = lambda v: F.exists(F.array(*(F.lit(a) for a in ALLOWED)), lambda a: F.regexp_like(v, a))

    def parts(c: Column) -> Column:
        inner = F.filter(_found(c["value"], PART), lambda p: ~p["value"].rlike(WORDS))
        moved = F.transform(inner, lambda p: F.struct((c["start"] + p["start"]).alias("start"), (c["start"] + p["stop"]).alias("stop"), p["value"].alias("value")))
        return F.when(c["value"].rlike(WORDS), moved).otherwise(F.array(c))

    def spans(c: Column) -> Column:
        return F.transform(windows_over(c["value"], limit(c["value"])), lambda s: _span(c["start"] + s["start"], "entropy", c["start"] + s["stop"]))

    candidates = F.flatten(F.transform(_found(text, CANDIDATE), parts))
    return F.flatten(F.transform(F.filter(candidates, lambda c: ~allowed(c["value"])), spans))


def _uncovered(spans: Column) -> Column:
    """Sorted spans without the entropy spans that lie in a base span that begins before them or where they do."""

    def kept(s: Column) -> Column:
        reach = _running(F.transform(s, lambda x: F.when(x["rank"] < len(PATTERNS), x["stop"]).otherwise(-1)), lambda a, b: F.greatest(a, b))
        told = F.zip_with(s, reach, lambda x, r: F.struct(x.alias("span"), ((x["rank"] == len(PATTERNS)) & (r >= x["stop"])).alias("covered")))
        return F.transform(F.filter(told, lambda t: ~t["covered"]), lambda t: t["span"])

    return _let(spans, kept)


def with_spans(docs: DataFrame, name: str) -> DataFrame:
    """`docs` and its spans (start, rank of the kind in `KINDS`, stop), sorted, under `name`."""
    text = free_name([*docs.columns, name], "clean")
    base, more = free_name([*docs.columns, name, text], "base"), free_name([*docs.columns, name, text], "more")
    out = docs.withColumn(text, F.translate(F.coalesce("text", F.lit("")), MARK, OTHER))
    out = out.withColumn(base, F.concat(*(_base(F.col(text), k) for k in PATTERNS)))
    out = out.withColumn(more, _entropy(F.col(text)))
    every = F.sort_array(F.concat(base, more))
    return out.withColumn(name, F.when(F.size(more) > 0, _uncovered(every)).otherwise(F.sort_array(F.col(base)))).drop(text, base, more)


def _listed(spans: Column) -> Column:
    kind = lambda s: F.get(F.array(*map(F.lit, KINDS)), s["rank"])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kind(s), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def secret_spans(docs: DataFrame) -> DataFrame:
    """doc_id, counts by base kind, the digest of the base spans, and all spans of each row of `docs` (doc_id, text)."""
    found = with_spans(docs.select("doc_id", "text"), "found")
    of = lambda kind: F.size(F.filter("found", lambda s: s["rank"] == KINDS.index(kind))).cast("long")
    base = F.filter("found", lambda s: s["rank"] < len(PATTERNS))
    counts = [of(k).alias(f"n_{k}") for k in PATTERNS]
    return found.select("doc_id", *counts, F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"), _listed(F.col("found")).alias("spans"))


def _masked(text: Column, spans: Column, label: str) -> Column:
    """The text with each span (start, stop; sorted, apart) replaced; done in blocks, so that no position is far away."""

    def block(piece: Column, k: Column, every: Column) -> Column:
        lo, n = k * MASK_BLOCK, F.length(piece)
        own = F.filter(every, lambda s: (s["stop"] > lo) & (s["start"] < lo + n))
        state = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

        def step(s: Column, span: Column) -> Column:
            begins = span["start"] >= lo
            left = F.when(begins, F.concat(piece.substr(s["at"] + 1, span["start"] - lo - s["at"]), F.lit(label))).otherwise(F.lit(""))
            return F.struct((span["stop"] - lo).alias("at"), F.concat(s["out"], left).alias("out"))

        return F.aggregate(own, state, step, lambda s: F.concat(s["out"], F.when(s["at"] < n, piece.substr(s["at"] + 1, n)).otherwise(F.lit(""))))

    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{MASK_BLOCK}}}"), F.lit(0))
    return _let(spans, lambda every: F.array_join(F.transform(pieces, lambda p, k: block(p, k, every)), ""))


def redacted(docs: DataFrame, label: str = "[secret]") -> DataFrame:
    """`docs` with all columns, each secret in text replaced by `label`; null text stays null."""
    spans = free_name(docs.columns, "spans")
    found = with_spans(docs, spans)
    text = F.when(F.size(spans) > 0, _masked(F.col("text"), merged(F.col(spans)), label)).otherwise(F.col("text"))
    return found.withColumn("text", text).select(*(F.col(f"`{c}`") for c in docs.columns))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_spans(read_table(spark, sf_dir, "documents"))


QUERIES = {"op5_secrets": op5_secrets}
def _oracle() -> str:
    """DuckDB's SQL: matches are marked and lengths summed as above, but each window's entropy is computed from its characters."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    marked = lambda text, pattern: f"string_split(regexp_replace({text}, {quoted('(' + pattern + ')')}, chr(1) || '\\1' || chr(1), 'g'), chr(1))"
    cut = lambda source, text, pattern, more="": f"(SELECT *, sum(length(part)) OVER (PARTITION BY doc_id{more} ORDER BY k) AS stop FROM (SELECT doc_id{more}, unnest(p) AS part, generate_subscripts(p, 1) AS k FROM (SELECT doc_id{more}, {marked(text, pattern)} AS p FROM {source}) q) q) q WHERE k % 2 = 0"
    base = " UNION ALL ".join(
        f"SELECT doc_id, {rank} AS rank, '{kind}' AS kind, stop - length(part) AS start, stop FROM {cut('d', 't', pattern)} AND length({f'regexp_extract(part, {quoted(pattern)}, {group})' if group else 'part'}) >= {least}"
        for rank, (kind, (pattern, group, least)) in enumerate(PATTERNS.items())
    )
    allowed = " OR ".join([f"regexp_matches(v, {quoted(a)})" for a in ALLOWED if "\\1" not in a] + ["replace(v, v[1], '') = ''"])
    limit = " ".join(f"WHEN regexp_matches(v, {quoted(pattern)}) THEN {bits}" for _, pattern, bits in CLASSES)
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
 base AS ({base}),
 runs AS (SELECT doc_id, stop - length(part) AS pos, part AS v FROM {cut("d", "t", CANDIDATE)}),
 parts AS (SELECT doc_id, pos, stop - length(part) AS later, part FROM {cut(f"(SELECT * FROM runs WHERE regexp_matches(v, '{WORDS}'))", "v", PART, ", pos")}),
 candidate AS (SELECT doc_id, pos, v FROM runs WHERE NOT regexp_matches(v, '{WORDS}') UNION ALL SELECT doc_id, pos + later, part FROM parts WHERE NOT regexp_matches(part, '{WORDS}')),
 fit AS (SELECT doc_id, pos, v, CASE {limit} END AS bits FROM candidate WHERE NOT ({allowed})),
 win AS (SELECT doc_id, pos, bits, v, unnest(range(0, length(v) - {SPAN - 1})) AS k FROM fit),
 hot AS (SELECT doc_id, pos, k FROM win WHERE list_aggregate(string_split(substr(v, k + 1, {SPAN}), ''), 'entropy') >= bits - 1e-9),
 grp AS (SELECT *, sum(CASE WHEN k - before <= {SPAN} THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, pos ORDER BY k) AS g FROM (SELECT *, lag(k) OVER (PARTITION BY doc_id, pos ORDER BY k) AS before FROM hot) q),
 entropy AS (SELECT doc_id, {len(PATTERNS)} AS rank, 'entropy' AS kind, pos + min(k) AS start, pos + max(k) + {SPAN} AS stop FROM grp GROUP BY doc_id, pos, g),
 every AS (SELECT * FROM base UNION ALL SELECT * FROM entropy e WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = e.doc_id AND b.start <= e.start AND b.stop >= e.stop)),
 told AS (SELECT doc_id, rank, start, kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT) AS span FROM every),
 found AS (SELECT doc_id, {", ".join(f"count(*) FILTER (WHERE rank = {rank}) AS n_{kind}" for rank, kind in enumerate(PATTERNS))}, string_agg(span, ',' ORDER BY start, rank) FILTER (WHERE rank < {len(PATTERNS)}) AS own, string_agg(span, ',' ORDER BY start, rank) AS spans FROM told GROUP BY doc_id)
SELECT d.doc_id AS doc_id, {", ".join(f"CAST(coalesce(n_{kind}, 0) AS BIGINT) AS n_{kind}" for kind in PATTERNS)}, sha256(coalesce(own, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN found f ON d.doc_id = f.doc_id"""


ORACLES = {"op5_secrets": _oracle()}
