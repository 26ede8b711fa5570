"""How many tokens texts have under a public vocabulary, from windows drawn through the whole of a long text.

A text of up to `WINDOWS` windows of `WINDOW` characters is counted whole. Of a longer one a window is drawn from each of
`WINDOWS` equal stretches, and the mean is scaled to the text; the error is two standard errors of that mean, so a text
whose parts differ says how little its count is known. Tokens that a window's edges cut are counted in halves.

Odd cases: null and empty texts have no tokens and no error. Equal texts have equal counts: the places of the windows
are drawn by a generator that starts from the text's length.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pandas as pd
import tiktoken
from pyspark.sql import Column
from pyspark.sql import functions as F

WINDOW, WINDOWS = 4096, 64


@lru_cache(maxsize=4)
def vocabulary(path: str, pattern: str) -> tiktoken.Encoding:
    """A vocabulary file of ranks (a token in base 64 and its rank a line)."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_count(text: str, tokenizer: tiktoken.Encoding, window: int = WINDOW, windows: int = WINDOWS) -> tuple[int, float]:
    """The number of tokens, and by how much it may be wrong (0 where it was counted)."""
    if len(text) <= window * windows:
        return len(tokenizer.encode_ordinary(text)), 0.0
    edges = np.linspace(0, len(text), windows + 1).astype(int)
    begins = np.random.default_rng(len(text)).integers(edges[:-1], edges[1:] - window, endpoint=True)
    counts = np.array([len(tokenizer.encode_ordinary(text[b : b + window])) for b in begins.tolist()], dtype=float)
    # a cut within a token makes two of it, so each edge adds half a token
    scale = len(text) / window
    spread = counts.std(ddof=1) * np.sqrt((1 - window * windows / len(text)) / windows) if windows > 1 else counts[0]
    return int(round((counts.mean() - 1) * scale)), float(2 * spread * scale)


def token_counts(text: Column | str, path: str, pattern: str, window: int = WINDOW, windows: int = WINDOWS) -> Column:
    """struct(tokens, error) of a text column."""

    def run(texts: pd.Series) -> pd.DataFrame:
        tokenizer = vocabulary(path, pattern)
        return pd.DataFrame([token_count(t, tokenizer, window, windows) if isinstance(t, str) else (0, 0.0) for t in texts], columns=["tokens", "error"])

    return F.pandas_udf(run, "tokens long, error double")(text)


def payload_sizes(rows, column: str, path: str, pattern: str):
    """`rows` with the bytes, kibibytes (one decimal), tokens and token error of a text column."""
    size = F.octet_length(F.coalesce(F.col(column), F.lit(""))).cast("long")
    return rows.withColumn("n_bytes", size).withColumn("kilobytes", F.round(F.col("n_bytes") / 1024, 1)).withColumn("counted", token_counts(column, path, pattern)).select(
        *rows.columns, "n_bytes", "kilobytes", "counted.tokens", F.col("counted.error").alias("tokens_error")
    )
