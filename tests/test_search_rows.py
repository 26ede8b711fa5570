"""What goes with each word of a keyword query."""

import re

from tablewell.functions import search
from tablewell.manifest import FullText
from tablewell.operators import ranked

PLAIN = FullText(True, "none", "none", "[^a-z0-9]+", False, True)


def _generated(df):
    """What each Generate of the plan explodes."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    passed = re.findall(r"Generate explode\((\w+)", plan)
    return plan, passed


def test_no_text_goes_with_its_words(spark):
    """The column that is exploded is left out of its rows, and it is a column of counts, made below with the length."""
    docs = spark.createDataFrame([(1, "the license, the licenses and a letter"), (2, None), (3, "released")], "doc_id long, text string")
    for df in (
        search.index(docs, "doc_id", ["text"], PLAIN),
        search.bm25(docs, "doc_id", ["text"], "the license", PLAIN),
        search.bm25(docs, "doc_id", ["text"], "licenses", FullText(True)),
    ):
        plan, passed = _generated(df)
        assert passed and {*passed} <= {"counts", "own", "_extract_term", "_extract_word"} and "explode(words" not in plan, (passed, plan)
    got = {(r.doc_id, r.term): (r.tf, r.length) for r in search.index(docs, "doc_id", ["text"], PLAIN).collect()}
    assert got[1, "the"] == (2, 7) and got[3, "released"] == (1, 1) and all(k != 2 for k, _ in got)


def test_blocks_are_numbered_not_partitions(spark, tmp_path):
    """Many small blocks need no task or file each, and the best rows are those of scoring all rows."""
    docs = spark.range(600).selectExpr("id AS doc_id", "concat_ws(' ', if(id % 7 = 0, 'license', 'x'), if(id % 11 = 0, 'apache license', 'y'), repeat('word ', cast(id % 13 AS int))) AS text")
    terms, sizes = search.index(docs, "doc_id", ["text"], PLAIN), search.lengths(docs, "doc_id", ["text"], PLAIN)
    made = ranked.RankedIndex.build(terms, sizes, "doc_id", PLAIN, str(tmp_path / "index"), block_rows=8)
    assert len(list((tmp_path / "index" / "rows").glob("part-*"))) <= 4
    rows = spark.read.parquet(str(tmp_path / "index" / "rows"))
    assert rows.groupBy("block").count().where("count > 8").count() == 0 and rows.select("block").distinct().count() == 75
    best, figures = made.top("license apache", 20)
    every = search.bm25(docs, "doc_id", ["text"], "license apache", PLAIN)
    want = [(r.doc_id, round(r.score, 6)) for r in every.selectExpr("doc_id", "round(score, 9) AS score").orderBy("score", "doc_id", ascending=[False, True]).limit(20).collect()]
    assert [(r.row, round(r.score, 6)) for r in best.collect()] == want and figures["read"] <= figures["blocks"]
