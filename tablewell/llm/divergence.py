"""Source divergence audit (operator 11): how far the sources of a language differ in their words.

Terms are counted per language and source. The vocabulary of a language, the terms that at least `LEAST` of its documents
hold, is reordered so that equal counts cluster: terms with the same counts in all sources become one entry with a length,
and entries are sorted by their counts. In this order each source's counts are a run-length column. For a pair of sources
the boundaries of their runs are intersected, and f of the two probabilities is multiplied by the length of each piece, so
the work follows the runs and not the terms.

A term is a run of ASCII letters and characters outside ASCII, with A-Z lower-cased. With a group's count of a term, N the
sum of its counts and V the number of kept terms, p = 1 + floor(SCALE * (count + 1) / (N + V)), and f(p, q) =
floor((p - q)^2 / q). All of this is exact: products that could pass 64 bits are made of Python's or decimal numbers.

Defined results: null text, lang and source are read as empty ones; every row counts as a document, repeated rows and rows
without an id too; a (lang, source) without terms takes part with counts of 0; a language with no kept term gives pairs of
value 0 and no terms; an empty table gives an empty result. Other columns aren't read. Texts of any length are counted in
pieces; what a task holds of counts is written out at `HELD` entries.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, read_table, slices, text_bytes, word_lists

LEAST = 3
SCALE = 1_000_000_000
TERMS = 200
HELD = 250_000
BLOCK_BYTES = 4 << 20
_LETTERS = bytes(b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in range(256)).lower()
_DOCUMENT = 1 << 64
"""A term's number of documents and its count are held in one number; this is one document."""

COUNTS = "lang string, source string, term string, n long, docs long"
COLUMN = "struct<source: string, starts: array<bigint>, counts: array<bigint>>"


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of (lang, source, term), and for each (lang, source) a row without a term."""
    held: dict[tuple[str, str], dict[bytes, int]] = {}
    size = 0
    for batch in slices(batches, 8 << 20):
        text, starts = text_bytes(batch.column(0))
        raw = text.tobytes().translate(_LETTERS)
        groups = zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)
        for k, group in enumerate(groups):
            own = held.setdefault(group, {})
            before = len(own)
            seen: set[bytes] = set()
            for words in word_lists(raw[starts[k] : starts[k + 1]]):
                for term, n in Counter(words).items():
                    if term in seen:
                        own[term] = own.get(term, 0) + n
                    else:
                        own[term] = own.get(term, 0) + n + _DOCUMENT
                        seen.add(term)
            size += len(own) - before
            if size >= HELD:
                yield from _flushed(held)
                held, size = {}, 0
    yield from _flushed(held)


def _flushed(held: dict[tuple[str, str], dict[bytes, int]]) -> Iterator[pa.RecordBatch]:
    for (lang, source), own in held.items():
        terms = pa.array([None, *own], pa.binary()).cast(pa.string())
        both = [0, *own.values()]
        fixed = [pa.array([x] * len(both), pa.string()) for x in (lang, source)]
        numbers = [pa.array([x % _DOCUMENT for x in both], pa.int64()), pa.array([x // _DOCUMENT for x in both], pa.int64())]
        yield pa.RecordBatch.from_arrays([*fixed, terms, *numbers], names=["lang", "source", "term", "n", "docs"])


def vocabulary(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, term, n, own) of each kept term: its count in the language, and in each source that has it, in order of sources.

    The row of a language whose term is null lists all its sources, with counts of 0.
    """
    empty = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    counts = docs.select(empty("text"), empty("lang"), empty("source")).mapInArrow(_counted, COUNTS)
    # tasks have summed their own rows, so one shuffle by (lang, term) serves both groupings
    each = counts.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    whole = each.groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"), F.array_sort(F.collect_list(F.struct("source", "n"))).alias("own"))
    return whole.where(F.col("term").isNull() | (F.col("docs") >= least)).drop("docs")


def group_sizes(kept: DataFrame) -> DataFrame:
    """(lang, source, total, kinds): a source's count of kept terms, and how many its language has."""
    kinds = kept.groupBy("lang").agg(F.count("term").alias("kinds"))
    totals = kept.select("lang", F.inline("own")).groupBy("lang", "source").agg(F.sum("n").alias("total"))
    return totals.join(kinds, "lang")


def _run_length(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries (lang, own, length) in order become blocks: for each source in it, the starts of its runs and their counts."""
    for batch in slices(batches, BLOCK_BYTES):
        langs = batch.column(0).dictionary_encode()
        lengths = np.asarray(batch.column(2), np.int64)
        own = batch.column(1)
        ends = np.asarray(own.offsets, np.int64)
        entry = np.repeat(np.arange(len(own)), np.diff(ends))
        flat = own.flatten()
        names = flat.field(0).dictionary_encode()
        kind, counts = np.asarray(names.indices), np.asarray(flat.field(1), np.int64)
        code = np.asarray(langs.indices)
        for k, lang in enumerate(langs.dictionary.to_pylist()):
            of = np.flatnonzero(code == k)
            first, last = of[0], of[-1] + 1
            at = np.concatenate([[0], np.cumsum(lengths[first:last])])
            within = (entry >= first) & (entry < last)
            columns = []
            for s in np.unique(kind[within]):
                mine = within & (kind == s)
                dense = np.zeros(last - first, np.int64)
                dense[entry[mine] - first] = counts[mine]
                begins = np.concatenate([[0], np.flatnonzero(np.diff(dense)) + 1])
                columns.append({"source": names.dictionary[int(s)].as_py(), "starts": at[begins], "counts": dense[begins]})
            yield pa.RecordBatch.from_pylist([{"lang": lang, "size": int(at[-1]), "columns": columns}], schema=_BLOCKS)


_BLOCKS = pa.schema(
    [
        ("lang", pa.string()),
        ("size", pa.int64()),
        ("columns", pa.list_(pa.struct([("source", pa.string()), ("starts", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64()))]))),
    ]
)


def probability(count: int, total: int, kinds: int) -> int:
    return 1 + SCALE * (count + 1) // (total + kinds)


def crossed(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], size: int) -> tuple[int, int]:
    """The sums of f(a, b) and f(b, a) over `size` terms, of two columns (starts of runs, probability in each).

    No product or sum passes 64 bits: a column's probabilities sum to about SCALE, so their squares to about SCALE squared.
    """
    cuts = np.union1d(a[0], b[0])
    widths = np.diff(np.append(cuts, size))
    p = a[1][np.searchsorted(a[0], cuts, "right") - 1]
    q = b[1][np.searchsorted(b[0], cuts, "right") - 1]
    square = (p - q) ** 2
    return int((square // q * widths).sum()), int((square // p * widths).sum())


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, item, value) of each block and pair of sources, from (lang, size, columns, groups)."""
    for batch in batches:
        for row in batch.to_pylist():
            runs = {c["source"]: (np.array(c["starts"], np.int64), np.array(c["counts"], np.int64)) for c in row["columns"] or []}
            nothing = (np.zeros(1, np.int64), np.zeros(1, np.int64))
            made = []
            for g in row["groups"]:
                starts, counts = runs.get(g["source"], nothing)
                kinds, places = np.unique(counts, return_inverse=True)
                chances = np.array([probability(c, g["total"], g["kinds"]) if g["kinds"] else 1 for c in kinds.tolist()], np.int64)
                made.append((g["source"], (starts, chances[places])))
            for k, (one, a) in enumerate(made):
                others = made[k + 1 :]
                both = [crossed(a, b, row["size"]) if row["size"] else (0, 0) for _, b in others]
                names = [x for x, _ in others]
                n = len(names)
                arrays = [pa.array([row["lang"]] * 2 * n, pa.string()), pa.array([one] * n + names, pa.string()), pa.array(names + [one] * n, pa.string())]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array([x for x, _ in both] + [y for _, y in both], pa.int64())], names=["lang", "source", "item", "value"])


def pair_divergence(kept: DataFrame, sizes: DataFrame) -> DataFrame:
    """(lang, source, item, value) of each ordered pair of sources of a language."""
    terms = kept.where("term IS NOT NULL")
    entries = terms.groupBy("lang", "own").agg(F.count("*").alias("length"))
    ordered = entries.repartitionByRange("lang", "own").sortWithinPartitions("lang", "own").select("lang", "own", "length")
    blocks = ordered.mapInArrow(_run_length, f"lang string, size bigint, columns array<{COLUMN}>")
    # a language without terms has its pairs from a block of no terms
    empty = sizes.select("lang").distinct().select("lang", F.lit(0).cast("bigint").alias("size"), F.lit(None).cast(f"array<{COLUMN}>").alias("columns"))
    groups = sizes.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", "total", "kinds"))).alias("groups"))
    met = blocks.unionByName(empty).join(groups, "lang").select("lang", "size", "columns", "groups")
    parts = met.mapInArrow(_pairs, "lang string, source string, item string, value bigint")
    return parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def _exact(count: str, total: str) -> str:
    wide = "decimal(28, 0)"
    return f"1 + cast({SCALE} as decimal(10, 0)) * cast({count} + 1 as {wide}) div cast({total} + kinds as {wide})"


def term_excess(kept: DataFrame, sizes: DataFrame) -> DataFrame:
    """(lang, source, item, value) of the terms that a source has more often than its language."""
    langs = kept.groupBy("lang").agg(F.sum("n").alias("lang_total"))
    each = kept.where("term IS NOT NULL").select("lang", F.col("term").alias("item"), F.col("n").alias("lang_n"), F.inline("own"))
    both = each.join(sizes.join(langs, "lang"), ["lang", "source"])
    chances = both.select("lang", "source", "item", F.expr(_exact("n", "total")).alias("p"), F.expr(_exact("lang_n", "lang_total")).alias("q"))
    return chances.where("p > q").select("lang", "source", "item", F.expr("(p - q) * (p - q) div q").alias("value"))


def audit(docs: DataFrame, least: int = LEAST, terms: int = TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): other sources by their divergence (`pair`, all of them), and the terms that
    stand out in a source against its language (`term`, the first `terms`)."""
    kept = materialise(vocabulary(docs, least))
    sizes = materialise(group_sizes(kept))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df, part: df.withColumn("rank", F.row_number().over(order)).withColumn("part", F.lit(part))
    pairs = ranked(pair_divergence(kept, sizes), "pair")
    # Spark keeps the first ranks of each task before it shuffles
    words = ranked(term_excess(kept, sizes), "term").where(F.col("rank") <= terms)
    return pairs.unionByName(words).select("lang", "source", "part", "item", "value", "rank")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(read_table(spark, sf_dir, "documents"))


QUERIES = {"op11_source_divergence": op11_source_divergence}
_A_TO_Z = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
ORACLES = {
    "op11_source_divergence": f"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), {_A_TO_Z}) AS t FROM documents),
 w AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
 v AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= {LEAST}),
 k AS (SELECT lang, CAST(count(*) AS HUGEINT) AS kinds FROM v GROUP BY lang),
 c AS (SELECT lang, source, term, CAST(count(*) AS HUGEINT) AS n FROM w JOIN v USING (lang, term) GROUP BY lang, source, term),
 g AS (SELECT g.lang AS lang, g.source AS source, coalesce(max(k.kinds), 0) AS kinds, coalesce(sum(c.n), 0) AS total FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN k ON g.lang = k.lang LEFT JOIN c ON g.lang = c.lang AND g.source = c.source GROUP BY g.lang, g.source),
 p AS (SELECT g.lang AS lang, g.source AS source, v.term AS term, coalesce(c.n, 0) AS n, 1 + {SCALE} * (coalesce(c.n, 0) + 1) // (g.total + g.kinds) AS p FROM g JOIN v ON g.lang = v.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = v.term),
 q AS (SELECT lang, term, 1 + {SCALE} * (sum(n) + 1) // (any_value(t.total) + any_value(kinds)) AS q FROM c JOIN (SELECT lang, sum(total) AS total, any_value(kinds) AS kinds FROM g GROUP BY lang) t USING (lang) GROUP BY lang, term),
 pairs AS (SELECT a.lang AS lang, a.source AS source, b.source AS item, coalesce(sum((a.p - b.p) * (a.p - b.p) // b.p), 0) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
 rows AS (SELECT x.lang AS lang, x.source AS source, 'pair' AS part, y.source AS item, coalesce(z.value, 0) AS value FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN pairs z ON z.lang = x.lang AND z.source = x.source AND z.item = y.source
  UNION ALL SELECT p.lang, p.source, 'term', p.term, (p.p - q.q) * (p.p - q.q) // q.q FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE p.n > 0 AND p.p > q.q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM rows) q WHERE part = 'pair' OR rank <= {TERMS}"""
}
