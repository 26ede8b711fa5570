"""Keyword search: tokens, stems and BM25 over DataFrames."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..manifest import FullText
from .likeness import pandas_jaro_winkler
from .snowball import stemmer

K1, B = 1.2, 0.75
# English words that an index leaves out.
STOPWORDS = (
    "a about above after again against all am an and any are as at be because been before being below between both but by can did do does "
    "doing don down during each few for from further had has have having he her here hers herself him himself his how i if in into is it its "
    "itself just me more most my myself no nor not now of off on once only or other our ours ourselves out over own s same she should so some "
    "such t than that the their theirs them themselves then there these they this those through to too under until up very was we were what "
    "when where which while who whom why will with you your yours yourself yourselves"
).split()


# Letters with marks, and the first letter of what a stemmer may make of them.
_MARKED, _UNMARKED = "äöüßáéíóúâàëêèïîôûùç", "aousaeiouaaeeeiiouuc"


def stemmed(words: Column | str, language: str) -> Column:
    """The stems of a column of words; each is stemmed once per batch."""
    stemmer(language)  # refuses unknown names before any job runs

    def stems(words: pd.Series) -> pd.Series:
        of = stemmer(language)
        return words.map({w: of(w) for w in words.dropna().unique()}, na_action="ignore")

    return words if language == "none" else F.pandas_udf(stems, T.StringType())(words)


def tokens(text: Column, settings: FullText) -> Column:
    """The tokens of a text, not stemmed yet."""
    if settings.strip_accents:
        text = F.regexp_replace(F.reflect(F.lit("org.apache.commons.lang3.StringUtils"), F.lit("stripAccents"), F.coalesce(text, F.lit(""))), "ß", "ss")
    if settings.lowercase:
        text = F.lower(text)
    words = F.filter(F.split(F.coalesce(text, F.lit("")), settings.ignore), lambda w: w != "")
    return F.filter(words, lambda w: ~w.isin(*STOPWORDS)) if settings.stopwords == "english" else words


def searched(df: DataFrame, settings: FullText) -> list[str]:
    """The columns that are searched: those of the settings that are there, else all texts but the system's."""
    texts = [c for c, kind in df.dtypes if kind == "string" and not c.startswith("_")]
    return [c for c in settings.columns if c in texts] or texts


def index_mark(settings: FullText, columns: list[str]) -> str:
    """Tells apart indexes that were made otherwise."""
    return hashlib.sha256(repr((settings, sorted(columns))).encode()).hexdigest()[:16]


def lengths(df: DataFrame, row_id: str, columns: list[str], settings: FullText) -> DataFrame:
    """(row id, length): the number of tokens of each row."""
    return df.select(row_id, F.size(F.concat(*(tokens(F.col(c), settings) for c in columns))).alias("length"))


def index(df: DataFrame, row_id: str, columns: list[str], settings: FullText) -> DataFrame:
    """An inverted index: a row for each document and term, (row id, term, tf, length).

    Terms are counted within the row and stemmed after that, so each is stemmed once per document.
    """
    whole = F.concat(*(tokens(F.col(c), settings) for c in columns))
    terms = _counted_terms(df.select(row_id, whole.alias("words")), row_id)
    if settings.stemmer != "none":
        terms = terms.withColumn("term", stemmed("term", settings.stemmer)).groupBy(row_id, "term").agg(F.sum("tf").alias("tf"), F.first("length").alias("length"))
    return terms


def _counted_terms(texts: DataFrame, row_id: str, heads: list[str] | None = None) -> DataFrame:
    """(row id, term, tf, length) from (row id, words), where `heads` are given of words that begin so.

    The length and the counts are made before anything is exploded, so no word's row carries its text along.
    """
    own = F.col("words") if heads is None else F.filter("words", lambda w: F.translate(F.substring(w, 1, 1), _MARKED, _UNMARKED).isin(*heads))
    counts = texts.select(row_id, F.size("words").alias("length"), counted_words(own).alias("counts"))
    return counts.select(row_id, "length", F.explode("counts").alias("w")).select(row_id, F.col("w.word").alias("term"), F.col("w.n").cast("long").alias("tf"), "length")


def query_terms(words: str, settings: FullText) -> list[str]:
    """Distinct terms of a query, as the index has them."""
    import re
    import unicodedata

    text = words
    if settings.strip_accents:
        text = "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))
    text = text.lower() if settings.lowercase else text
    found = [w for w in re.split(f"(?:{settings.ignore})".replace("(\\.|", "(?:\\.|"), text) if w]
    if settings.stopwords == "english":
        found = [w for w in found if w not in STOPWORDS]
    return sorted(set(map(stemmer(settings.stemmer), found)))


def bm25(df: DataFrame, row_id: str, columns: list[str], words: str, settings: FullText) -> DataFrame:
    """(row id, score) of the rows that hold a query term; others have no row.

    Only the terms of the query leave the texts, each with its count; the corpus figures are one row.
    """
    terms = query_terms(words, settings)
    whole = F.concat(*(tokens(F.col(c), settings) for c in columns))
    texts = df.select(row_id, whole.alias("words"))
    corpus = texts.agg(F.count("*").alias("n"), F.avg(F.size("words")).alias("mean"))
    if not terms:
        return df.sparkSession.createDataFrame([], "row string, score double").select(F.col("row").alias(row_id), "score")
    if settings.stemmer == "none":
        tf = lambda t: F.size(F.filter("words", lambda w: w == t)).cast("long")
        each = F.array(*(F.struct(F.lit(t).alias("term"), tf(t).alias("tf")) for t in terms))
        own = texts.select(row_id, F.size("words").alias("length"), F.filter(each, lambda x: x["tf"] > 0).alias("own"))
        hits = own.select(row_id, "length", F.explode("own").alias("w")).select(row_id, "w.term", "w.tf", "length")
    else:
        # a stem begins as its words do, but for marks; so most words needn't be stemmed
        heads = sorted({t[:1] for t in terms})
        found = _counted_terms(texts, row_id, heads).withColumn("term", stemmed("term", settings.stemmer)).where(F.col("term").isin(*terms))
        hits = found.groupBy(row_id, "term").agg(F.sum("tf").alias("tf"), F.first("length").alias("length"))
    return _scores(hits, corpus, row_id)


def bm25_of(terms: DataFrame, sizes: DataFrame, row_id: str, words: str, settings: FullText) -> DataFrame:
    """The scores of `bm25` from an index and the lengths of all rows: only the query's terms are read."""
    wanted = query_terms(words, settings)
    if not wanted:
        return terms.select(row_id, F.lit(None).cast("double").alias("score")).limit(0)
    corpus = sizes.agg(F.count("*").alias("n"), F.avg("length").alias("mean"))
    return _scores(terms.where(F.col("term").isin(*wanted)), corpus, row_id)


def _scores(hits: DataFrame, corpus: DataFrame, row_id: str) -> DataFrame:
    df_of = hits.groupBy("term").agg(F.count("*").alias("df"))
    # both sides are tiny: a row for each query term, and one row
    scored = hits.join(F.broadcast(df_of), "term").crossJoin(F.broadcast(corpus))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    return scored.groupBy(row_id).agg(F.sum(weight).alias("score"))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once, however often it is named there."""
    return F.element_at(F.transform(F.array(value), use), 1)


def counted_words(words: Column) -> Column:
    """(n, word) of the distinct words of an array: it is sorted, and the places where another word begins are a count apart."""

    def runs(s: Column) -> Column:
        begins = F.filter(F.transform(s, lambda w, k: F.when((k == 0) | (F.get(s, k - 1) != w), k)), lambda k: k.isNotNull())
        ends = lambda b: F.slice(F.concat(F.slice(b, F.lit(2), F.size(b)), F.array(F.size(s))), F.lit(1), F.size(b))
        return _let(begins, lambda b: F.zip_with(b, ends(b), lambda x, y: F.struct((y - x).alias("n"), F.get(s, x).alias("word"))))

    return _let(F.sort_array(words), runs)


def rarest_words(df: DataFrame, row_id: str, text: str, k: int = 8) -> DataFrame:
    """(row id, words): the k rarest words of each row's text, of 4 letters or more and not all digits; ties by alphabet. Words
    are counted within the row, so nothing is shuffled; rows without such words are left out."""
    words = F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: (F.length(w) >= 4) & ~w.rlike("^[0-9]+$"))
    rarest = F.slice(F.sort_array(counted_words(words)), 1, k)
    return df.select(row_id, F.transform(rarest, lambda x: x["word"]).alias("words")).where(F.size("words") > 0)


def register(spark: SparkSession) -> None:
    """The Python functions of tenant SQL."""
    spark.udf.register("jaro_winkler_similarity", F.pandas_udf(pandas_jaro_winkler, T.DoubleType()))
    spark.udf.register("stem", F.pandas_udf(_stems_by_language, T.StringType()))


def _stems_by_language(words: pd.Series, language: pd.Series) -> pd.Series:
    return pd.Series([None if w is None or lang is None else stemmer(lang)(w) for w, lang in zip(words, language, strict=True)], dtype=object)
