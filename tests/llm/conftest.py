import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, mark string, score double, row int"


def words(rng, n, kinds=400):
    return " ".join(f"w{rng.randrange(kinds)}" for _ in range(n))


def make_rows():
    """Nulls, empty and blank texts, copies, near copies, shared passages, secrets, long texts and repeated rows."""
    rng = random.Random(5)
    passage = "this passage of more than fifty bytes stands in several of the documents, word for word."
    texts = [None, "", " \n\t ", "a", "ß é 日本 😀", "x" * 700, "ab" * 300]
    texts += [words(rng, rng.randrange(1, 120)) for _ in range(40)]
    texts += [words(rng, 30) + "\n" + passage + " " + words(rng, 20) for _ in range(6)]
    base = words(rng, 400, 5000)
    texts += [base, base, base + " tail", base.upper(), base.replace("w1", "v1", 1)]
    texts += ['key token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" end', "AKIA" + "Q7" * 10 + " password: hunter2hunter2", "secret: token: abcdefgh api_key=x1"]
    texts += ["aB3dE6gH9jK2mN5pQ8sT1vW4yZ7xC0 in a line", "The  quick Brown\r\nfox", "the quick brown fox", words(rng, 12000, 3000)]
    texts += ["mail anna.1@mail7.example.org or call +1 (017) 555-7713", "mail anna.1@mail7.example.org from 97.51.17.173, card 9807915762804490", "Mrs. Anna Schmidt met Mr. Paul Meyer"]
    texts += ["the end <|endoftext|> and on <|endoftext|>", "paths/example-" + "q7Rt" * 9 + "/x"]
    texts += ["line one here\nline one here\nother\nline one here\n" * 4, "%%% ### $$$ " * 12]
    rows = [(k * 3, t, "en", "s", len(t or ""), "m", 0.5, k) for k, t in enumerate(texts)]
    rows += [rows[20], rows[20], (None, texts[21], None, None, None, None, None, None), (None, None, None, None, None, None, None, None), (None, texts[22], None, None, None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def rows():
    return make_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
