"""Quality rules (operator 6): a ledger of rule bits.

Every rule is evaluated once per document. The ledger keeps the measurements and one long with a bit for each rule that
failed. A policy is a version with a mask of the rules that count; applying one, and asking what each of its rules alone
decides (the ablation), need the bits only.

Words are `[^\\x20\\x09-\\x0D]+`. Defined results: null text has no words; a text without words fails `few_words`; null
doc_ids pass; repeated rows each get their row; an empty table gives an empty ledger.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, slices

WINDOW = 8
SYMBOLS = "#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_upper", "n_word_kinds", "n_long_words", "n_stutters")
LEDGER = "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES)

# Name and failing condition of each rule; a rule's place is its bit.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 20"),
    ("repeated_words", "100 * n_repeat_words > 30 * n_words"),
    ("symbols", "10 * n_symbols > 2 * n_words"),
    ("repeated_lines", "n_lines >= 4 and 100 * n_dup_lines > 50 * n_lines"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 15 * n_words"),
    ("capitals", "n_letters >= 20 and 100 * n_upper > 60 * n_letters"),
    ("few_letters", "100 * n_letters < 50 * word_chars"),
    ("few_kinds", "n_words >= 50 and n_words <= 2000 and 100 * n_word_kinds < 10 * n_words"),
    ("unbroken_text", "100 * n_long_words > 20 * n_words"),
    ("stutters", "n_words >= 20 and 100 * n_stutters > 30 * n_words"),
)
BASE = ("few_words", "repeated_words")
# The rules that each version of the policy counts.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": BASE,
    "1": (*BASE, "symbols", "repeated_lines", "short_words", "long_words", "capitals", "few_letters"),
    "2": tuple(name for name, _ in RULES),
}
LATEST = "2"
_SPACE = re.compile(r"[\x20\x09-\x0D]")


def mask(names: tuple[str, ...]) -> int:
    return sum(1 << k for k, (name, _) in enumerate(RULES) if name in names)


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words in windows of `window` words that are found twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    kinds: dict[bytes, int] = {}
    ids = np.array([kinds.setdefault(w, len(kinds)) for w in words], np.int64)
    # numbers of runs of 1, 2, 4, ... words: equal numbers stand for equal runs
    size = 1
    while size * 2 <= window:
        ids = np.unique(ids[:-size] * (len(words) + 1) + ids[size:], return_inverse=True)[1]
        size *= 2
    if size < window:
        rest = window - size
        ids = np.unique(ids[: len(ids) - rest] * (len(words) + 1) + ids[rest:], return_inverse=True)[1]
    again = np.bincount(ids)[ids] > 1
    if not again.any():
        return 0
    cover = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(again)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + window, -1)
    return int((np.cumsum(cover[:-1]) > 0).sum())


def measure(text: str | None) -> tuple[int, ...]:
    """The measurements of one text, in the order of MEASURES."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    lines = [x for x in (text.split("\n") if words else []) if _SPACE.sub("", x)]
    letters = sum(map(str.isalpha, text))
    return (
        len(words),
        len(text) - len(_SPACE.findall(text)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        letters,
        sum(map(str.isupper, text)),
        len(set(words)),
        sum(len(w) > 40 for w in words),
        sum(map(operator.eq, words, words[1:])),
    )


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 4 << 20):
        columns = list(zip(*map(measure, batch.column(1).to_pylist()), strict=True)) or [()] * len(MEASURES)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns)], names=["doc_id", *MEASURES])


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements and `failed`, the bits of the rules that failed, of each row of `docs` (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_measure, LEDGER)
    bits = (f"if({condition}, {1 << k}L, 0L)" for k, (_, condition) in enumerate(RULES))
    return rows.withColumn("failed", F.expr(" | ".join(bits)))


def passes(policy: str = LATEST) -> Callable:
    """The condition, over a ledger, that a policy keeps a document."""
    return F.col("failed").bitwiseAND(F.lit(mask(POLICIES[policy]))) == 0


def ablation(rows: DataFrame, policy: str = LATEST) -> DataFrame:
    """For each rule of a policy: documents that it fails, that it alone fails, and that stay if it is left out.

    The ledger is first counted by its bits, of which there are at most 2 ** len(RULES) whatever the number of documents.
    """
    whole = mask(POLICIES[policy])
    counted = rows.groupBy(F.col("failed").bitwiseAND(F.lit(whole)).alias("bits")).agg(F.count("*").alias("n"))
    own = [(name, 1 << k) for k, (name, _) in enumerate(RULES) if name in POLICIES[policy]]
    each = F.explode(F.array(*(F.struct(F.lit(name).alias("rule"), F.lit(bit).cast("long").alias("bit")) for name, bit in own)))
    wide = counted.select("bits", "n", each.alias("r")).select("bits", "n", "r.rule", "r.bit")
    count = lambda condition: F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0)).cast("long")
    has = F.col("bits").bitwiseAND(F.col("bit")) != 0
    return wide.groupBy("rule").agg(
        count(has).alias("n_failed"),
        count(F.col("bits") == F.col("bit")).alias("n_failed_alone"),
        count((F.col("bits") == 0) | (F.col("bits") == F.col("bit"))).alias("n_kept_without"),
    )


def op6_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger(read_table(spark, sf_dir, "documents"))
    base_failed = F.col("failed").bitwiseAND(F.lit(mask(BASE))) != 0
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed.alias("base_failed"), passes().alias("kept"), "failed")


QUERIES = {"op6_rule_ledger": op6_rule_ledger}
_MEASURED = """WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
 w AS (SELECT doc_id, t, list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
 g AS (SELECT doc_id, unnest(range(1, len(words) - 6)) AS k, unnest(list_transform(range(1, len(words) - 6), lambda k: array_to_string(words[k : k + 7], ' '))) AS gram FROM w),
 again AS (SELECT doc_id, k FROM (SELECT doc_id, k, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g) q WHERE n > 1),
 covered AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(k, k + 8)) AS place FROM again) q GROUP BY doc_id),
 m AS (SELECT w.doc_id AS doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
  len(lines) AS n_lines, length(regexp_replace(t, '[^\\p{{L}}]', '', 'g')) AS n_letters, length(regexp_replace(t, '[^\\p{{Lu}}]', '', 'g')) AS n_upper, len(list_distinct(words)) AS n_word_kinds,
  len(list_filter(words, lambda x: strlen(x) > 40)) AS n_long_words, len(list_filter(range(1, len(words)), lambda k: words[k] = words[k + 1])) AS n_stutters
  FROM w LEFT JOIN covered c ON w.doc_id = c.doc_id),
 f AS (SELECT *, CAST({bits} AS BIGINT) AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed & {base}) <> 0 AS base_failed, (failed & {whole}) = 0 AS kept, failed FROM f"""
ORACLES = {"op6_rule_ledger": _MEASURED.format(bits=" + ".join(f"CASE WHEN {condition} THEN {1 << k} ELSE 0 END" for k, (_, condition) in enumerate(RULES)), base=mask(BASE), whole=mask(POLICIES[LATEST]))}
