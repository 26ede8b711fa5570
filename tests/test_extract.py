"""Typed rows from files whose headers differ."""

import pytest

from tablewell.operators import extract
from tablewell.operators.extract import Wanted


def run(spark, files, columns=None):
    rows, errors = extract.extracted(spark.createDataFrame(list(files.items()), "path string, content string").repartition(3), columns)
    return rows, {r["_path"]: r.error for r in errors.collect()}


def plain(rows, *names):
    return sorted((tuple(r) for r in rows.select("_path", "_row", *names).collect()), key=lambda r: r[:2])


def test_types_are_joined_over_the_files(spark):
    files = {
        "a": "Ident,Ok,Much,Zip,Wide,Mixed\n1,true,3,07,9007199254740991,true\n2,false,,8,5,\n",
        "b": "Mixed;Ident;Extra Col!\n4;3000000000;x\n;;y\n",
        "c": "Much\tOk\n2.5e1\t\n",
        "d": "Wide|Ok\n9007199254740992|true\n",
    }
    rows, errors = run(spark, files)
    assert errors == {}
    kinds = dict(rows.dtypes)
    assert {n: kinds[n] for n in ("ident", "ok", "much", "zip", "wide", "mixed", "extra_col")} == dict(ident="bigint", ok="boolean", much="double", zip="string", wide="string", mixed="string", extra_col="string")
    assert plain(rows, "ident", "ok", "much", "zip", "mixed", "extra_col") == [
        ("a", 0, 1, True, 3.0, "07", "true", None), ("a", 1, 2, False, None, "8", None, None), ("b", 0, 3000000000, None, None, None, "4", "x"),
        ("b", 1, None, None, None, None, None, "y"), ("c", 0, None, None, 25.0, None, None, None), ("d", 0, None, True, None, None, None, None),
    ]


def test_a_file_that_does_not_fit_is_an_error_and_no_failure(spark):
    files = {"good": "When,N\n2024-01-02,5\n", "bad": "N;When\n6;2024-01-03\nseven;2024-01-04\n8;x", "late": "N,When\n1,soon", "empty": "", "blank": "\n\n", "none": None, "open": 'N,When\n"1,2', "long": "N\n1,2", "no rows": "N,When\n", "wide": ",".join(f"h{k}" for k in range(600))}
    rows, errors = run(spark, files, [Wanted("n", "N", type="INTEGER"), Wanted("at", " when ", type="DATE"), Wanted("kind", value="x")])
    assert [(p, n, str(at), k) for p, _, n, at, k in plain(rows, "n", "at", "kind")] == [("good", 5, "2024-01-02", "x")]
    assert errors.pop("open").startswith("the file can't be read")
    header = "a delimited file needs a header"
    assert errors == {"bad": "column n: seven is no INTEGER", "late": "column at: soon is no DATE", "empty": header, "blank": header, "none": header, "long": "a record has 2 fields, the header 1", "wide": "more than 512 fields"}


def test_quotes_and_repeated_paths(spark):
    df = spark.createDataFrame([("p", 'a,b\n"x, ""y""\nz",1\n'), ("p", "b\n2\n"), ("q", "b,b\n3,4\n")], "path string, content string")
    rows, errors = extract.extracted(df)
    assert errors.count() == 0
    assert sorted((tuple(r) for r in rows.select("_path", "a", "b", "b_2").collect()), key=str) == sorted([("p", 'x, "y"\nz', 1, None), ("p", None, 2, None), ("q", None, 3, 4)], key=str)


def test_wrong_declarations_and_no_files(spark):
    none = spark.createDataFrame([], "path string, content string")
    for wrong in ([Wanted("a")], [Wanted("a", "b", "c")], [Wanted("a", "b", type="MONEY")], [Wanted("a", "b"), Wanted("A", "c")], [Wanted("1a", "b")]):
        with pytest.raises(ValueError):
            extract.extracted(none, wrong)
    rows, errors = extract.extracted(none, [Wanted("a", "b", type="BIGINT")])
    assert rows.count() == errors.count() == 0 and dict(rows.dtypes)["a"] == "bigint"
