"""The gate, tenant queries, search, vectors and paging."""

import math
import random
import time

import numpy as np
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tablewell import gate, query
from tablewell.functions import search, vectors
from tablewell.functions.porter import stem
from tablewell.functions.snowball import STEMMERS, stemmer
from tablewell.manifest import ColumnSpec, FullText
from tablewell.operators import ranked
from tablewell.query import Tenant
from tablewell.store import Store


@pytest.fixture(scope="module")
def tenant(spark, tmp_path_factory):
    store = Store(spark, str(tmp_path_factory.mktemp("tenant") / "store"))
    rows = [(k, f"note about {w} number {k}", "ann" if k % 2 else "bob") for k, w in enumerate(["running shoes", "the river", "a license", "cats", "running water"] * 5)]
    columns = [ColumnSpec("n", "BIGINT"), ColumnSpec("body", "VARCHAR", embedded=True), ColumnSpec("author", "VARCHAR")]
    store.add_rows("notes", spark.createDataFrame(rows, "n long, body string, author string"), columns, ["n"])
    view = store.view("notes")
    made = view.select("_row_id", F.lit("body").alias("column"), vectors.hash_embedding("body").alias("vector"))
    store.put_vectors("notes", made, "hash-bow-v1", vectors.DIMS)
    store.configure("notes", FullText(True))
    return Tenant(store)


ATTACKS = [
    "DROP TABLE notes", "INSERT INTO notes VALUES (1)", "SELECT 1; SELECT 2", "SET spark.x = 1", "FROM notes INSERT INTO x SELECT *", "CREATE VIEW v AS SELECT 1", "", "EXPLAIN SELECT 1",
    "SELECT * FROM csv.`/etc/passwd`", "SELECT * FROM parquet.`/tmp`", "SELECT reflect('java.lang.System', 'getenv', 'PATH')", "SELECT java_method('java.lang.System', 'exit', '1')",
    "SELECT * FROM nowhere", "BEGIN SELECT 1; END", "WITH x AS (SELECT reflect('a', 'b')) SELECT * FROM x", "SELECT (SELECT max(a) FROM secret)", "SELECT * FROM read_files('/etc')", "SHOW TABLES", "SELECT try_reflect('a', 'b')",
]


@pytest.mark.parametrize("sql", ATTACKS)
def test_attacks_are_refused(tenant, sql):
    with pytest.raises((gate.Refused, ValueError)) as e:
        tenant.query(sql or " ")
    assert query.is_callers_fault(e.value)


ESCAPES = [
    "SELECT to_json(body_vec) FROM notes", "SELECT body_vec[0] FROM notes", "SELECT size(body_vec) FROM notes", "SELECT CAST(body_vec AS STRING) FROM notes", "SELECT explode(body_vec) FROM notes",
    "SELECT max(body_vec) FROM notes", "SELECT struct(body_vec) FROM notes", "SELECT x[1] FROM (SELECT body_vec AS x FROM notes)", "SELECT body_vec FROM notes UNION ALL SELECT body_vec FROM notes", "SELECT DISTINCT body_vec FROM notes",
    "SELECT body_vec FROM notes", "SELECT CAST(body_vec AS ARRAY<DOUBLE>) AS x FROM notes", "SELECT array_inner_product(body_vec, array(1f, 0f)) FROM notes", "SELECT array_inner_product(a.body_vec, b.x_vec) FROM notes a CROSS JOIN (SELECT array(1f) AS x_vec) b",
]


@pytest.mark.parametrize("sql", ESCAPES)
def test_vectors_do_not_leave(tenant, sql):
    with pytest.raises(Exception):  # noqa: B017
        tenant.query(sql)


def test_statements_that_are_allowed(tenant):
    one = lambda sql, **k: tenant.query(sql, **k)["rows"]
    assert one("SELECT count(*) AS n FROM notes") == [{"n": "25"}]
    assert one("WITH a AS (SELECT author, n FROM notes) SELECT author, sum(n) AS s FROM a GROUP BY 1 ORDER BY 1")[0] == {"author": "ann", "s": "144"}
    assert one("SELECT row_number() OVER (ORDER BY n) AS k FROM notes LIMIT 1") == [{"k": 1}]
    assert one('SELECT "author" FROM notes WHERE n = 1') == [{"author": "ann"}]
    assert "body_vec" not in one("SELECT * FROM notes LIMIT 1")[0]
    assert one("SELECT column_name FROM information_schema_columns WHERE table_name = 'notes' ORDER BY ordinal_position")[0] == {"column_name": "n"}
    assert set(one("SELECT * EXCLUDE (author, _row_id, _batch, _ingested_at) FROM notes LIMIT 1")[0]) == {"n", "body"}
    assert one("SELECT id FROM range(3) ORDER BY id DESC LIMIT 1") == [{"id": "2"}]
    assert one("SELECT round(jaro_winkler_similarity('MARTHA', 'MARHTA'), 4) AS s") == [{"s": 0.9611}]


def test_idioms_that_spark_spells_otherwise(tenant):
    one = lambda sql, **k: tenant.query(sql, **k)["rows"]
    assert one("SELECT column_name FROM information_schema.columns WHERE table_name = 'notes' ORDER BY ordinal_position")[1] == {"column_name": "body"}
    assert one("SELECT table_name FROM information_schema.tables") == [{"table_name": "notes"}]
    assert one("SELECT n * 2 AS twice, author FROM notes WHERE twice > 44 AND n < 24 ORDER BY twice") == [{"twice": "46", "author": "ann"}]
    assert one("SELECT n, author FROM notes QUALIFY row_number() OVER (PARTITION BY author ORDER BY n DESC) = 1 ORDER BY n") == [{"n": "23", "author": "ann"}, {"n": "24", "author": "bob"}]
    assert one("SELECT n, 'a QUALIFY b' AS t FROM notes WHERE n IN (SELECT max(n) FROM notes) LIMIT 1") == [{"n": "24", "t": "a QUALIFY b"}]
    assert set(one("SELECT COLUMNS('^(n|auth.*)$') FROM notes LIMIT 1")[0]) == {"n", "author"}
    told = {r["column_name"]: r for r in one("SUMMARIZE notes")}
    assert [told["n"][k] for k in ("column_type", "count", "nulls", "min", "max", "avg", "q25", "q50", "q75")] == ["bigint", "25", "0", "0", "24", "12.0", "6", "12", "18"]
    assert told["n"]["std"].startswith("7.359") and told["author"]["avg"] is None and told["author"]["min"] == "ann" and told["author"]["approx_unique"] == "2"
    assert one("SELECT n, 'fts_main_notes.match_bm25(_row_id, ''run'')' AS t FROM notes ORDER BY n LIMIT 1")[0]["t"].startswith("fts_main")
    for wrong in ("SELECT nothing AS x FROM notes WHERE y = 1", "SUMMARIZE nowhere", "SELECT COLUMNS('zzz') FROM notes"):
        with pytest.raises(Exception):  # noqa: B017
            tenant.query(wrong)


FUNCTIONS = ["spark_partition_id()", "input_file_name()", "current_user()", "java_method('a', 'b')", "raise_error('x')", "no_such()", "version()", "from_avro(body, 'x')", "hll_sketch_estimate(body)"]


@pytest.mark.parametrize("call", FUNCTIONS)
def test_functions_are_allowed_by_list(tenant, call):
    with pytest.raises(gate.Refused, match="not allowed"):
        tenant.query(f"SELECT {call} AS x FROM notes")


def test_text_needs_the_model_of_the_vectors(tenant):
    other = Tenant(tenant.store, embed=lambda text: [0.0] * 8, model="another")
    with pytest.raises(gate.Refused, match="another"):
        other.query(text="cats")
    with pytest.raises(gate.Refused, match="another"):
        other.query("SELECT n, array_cosine_similarity(body_vec, $q) AS s FROM notes", text="cats")


def test_text_queries_rank_by_likeness(tenant):
    got = tenant.query(text="note about cats number 3", limit=3)["rows"]
    assert got[0]["n"] == "3" and got[0]["score"] > 0.99 and "body_vec" not in got[0]
    mixed = tenant.query("SELECT n, array_cosine_similarity(body_vec, $q) AS s FROM notes WHERE body_vec IS NOT NULL AND author = 'ann' ORDER BY s DESC LIMIT 2", text="note about cats number 3")["rows"]
    assert mixed[0]["n"] == "3"


def test_keyword_scores_in_sql(tenant):
    got = tenant.query("SELECT n, fts_main_notes.match_bm25(_row_id, 'run') AS s FROM notes ORDER BY s DESC NULLS LAST, n")["rows"]
    assert [r["n"] for r in got if r["s"] is not None] == ["0", "4", "5", "9", "10", "14", "15", "19", "20", "24"]


def test_pages_show_each_row_once(tenant):
    sql, seen, after = "SELECT n FROM notes ORDER BY n", [], None
    while True:
        page = tenant.query(sql, limit=10, after=after)
        seen += [int(r["n"]) for r in page["rows"]]
        after = page["cursor"]
        if after is None:
            break
    assert seen == list(range(25))
    token = tenant.query(sql, limit=5)["cursor"]
    for wrong, other in ((token, "SELECT n FROM notes"), ("garbage", sql)):
        with pytest.raises(gate.Refused):
            tenant.query(other, after=wrong)


@pytest.mark.parametrize("seconds", [0.02, 0.3, 2])
def test_slow_queries_are_cancelled_for_good(spark, tenant, seconds):
    # a join whose small side is a job of its own, so there are gaps between jobs in which nothing runs
    slow = "SELECT count(*) AS n FROM range(2000000000) a JOIN (SELECT n % 3 AS k FROM notes) b ON a.id % 7 = b.k WHERE a.id * a.id % 11 = 3"
    with pytest.raises(TimeoutError):
        tenant.query(slow, seconds=seconds)
    quiet = 0
    for _ in range(100):
        quiet = quiet + 1 if not spark.sparkContext.statusTracker().getActiveJobsIds() else 0
        time.sleep(0.1)
        if quiet == 30:
            break
    assert quiet == 30
    assert tenant.query("SELECT count(*) AS n FROM notes")["rows"] == [{"n": "25"}]


def test_aggregates_stay_out_of_where(tenant):
    for wrong in ("SELECT count(*) AS c FROM notes WHERE c > 1", "SELECT author, count(*) + 1 AS c FROM notes WHERE c > 1", "SELECT sum(n) AS c, 1 AS d FROM notes WHERE d = 1"):
        with pytest.raises(AnalysisException):
            tenant.query(wrong)
    inner = "SELECT c + 1 AS d FROM (SELECT author, count(*) AS c FROM notes GROUP BY author) t WHERE d > 1 ORDER BY d"
    assert tenant.query(inner)["rows"] == [{"d": "13"}, {"d": "14"}]


def test_scores_show_where_they_are_asked_for(tenant):
    score = "fts_main_notes.match_bm25(_row_id, 'run')"
    assert set(tenant.query(f"SELECT * FROM notes WHERE {score} IS NOT NULL LIMIT 1")["rows"][0]) == {"n", "body", "author", "_row_id", "_batch", "_ingested_at"}
    assert set(tenant.query(f"SELECT n, {score} FROM notes WHERE {score} > 0 LIMIT 1")["rows"][0]) == {"n", "match_bm25"}
    assert len(tenant.query(f"SELECT *, {score} AS s FROM (SELECT * FROM notes) notes ORDER BY s DESC LIMIT 1")["rows"][0]) == 7


@pytest.mark.parametrize("predicate", ["n = 1); DROP", "n = 1 -- x", "(n = 1", "n IN (SELECT 1)", "reflect('a','b') = 1", "'", "", "n = 1)) OR ((1 = 1"])
def test_predicates_are_contained(spark, predicate):
    with pytest.raises(gate.Refused):
        gate.check_predicate(spark, predicate)


@pytest.mark.parametrize("word, want", [("running", "run"), ("caresses", "caress"), ("ponies", "poni"), ("relational", "relat"), ("hopping", "hop"), ("falling", "fall"), ("happy", "happi"), ("sky", "sky"), ("generalization", "gener"), ("controll", "control"), ("agreed", "agre"), ("conflated", "conflat"), ("adoption", "adopt")])
def test_stems(word, want):
    assert stem(word) == want


# Words and stems of the published samples, one after the other.
SAMPLES = {
    "german": "aufeinander aufeinand aufeinanderfolge aufeinanderfolg aufeinanderfolgenden aufeinanderfolg aufeinanderschlügen aufeinanderschlug aufenthaltes aufenthalt auferlegt auferlegt auferlegten auferlegt auferstehung aufersteh auferstünde auferstund auffallend auffall auffälliges auffall auffassung auffass auffaßt auffasst kategorie kategori kategorien kategori kategorisch kategor kater kat katers kat",
    "french": "continu continu continua continu continuait continu continuant continu continuation continu continue continu continué continu continuel continuel continuelle continuel continuellement continuel continuels continuel continuer continu continuerait continu continueront continu continuité continu continuons continuon contorsions contors contournait contourn contracter contract contractés contract contractions contract contradictoirement contradictoir contradictoires contradictoir contraindre contraindr contraintes contraint contraria contrari mains main maintenaient mainten maintenait mainten maintenant mainten maintenir mainten maintenue maintenu maintien maintien maire mair mairie mair mais mais maisons maison maîtresses maîtress majesté majest majestueuse majestu majestueusement majestu majestueux majestu majeure majeur majordomes majordom majorité major majorités major malacca malacc maladie malad maladies malad maladive malad",
    "spanish": "chequeo cheque cheques chequ checar chec checoslovaquia checoslovaqui chester chest chetumaleños chetumaleñ cheyenne cheyenn chía chi chiapaneca chiapanec chicharrones chicharron torá tor tórax torax torcer torc toreado tor toreados tor toreándolo tor torear tor toreara tor torearlo tor toreó tore torero torer torio tori tormentas torment tornado torn tornen torn torneos torne tornillos tornill torniquete torniquet torpedearon torped torpeza torpez torrenciales torrencial torreón torreon torrescano torrescan",
    "english": "consigned consign consignment consign consistency consist consistently consist consolations consol consolatory consolatori console consol consolidated consolid consolingly consol consonant conson conspicuously conspicu conspiracy conspiraci conspirators conspir constables constabl constance constanc constancy constanc knackeries knackeri knaves knave knavish knavish kneading knead knee knee knees knee knightly knight knitted knit knives knive knocker knocker running run",
}


@pytest.mark.parametrize("language", SAMPLES)
def test_stems_of_the_published_samples(language):
    both = SAMPLES[language].split()
    assert [STEMMERS[language](w) for w in both[::2]] == both[1::2]


@pytest.mark.parametrize("language", STEMMERS)
def test_stemmers_take_any_word(language):
    rng = random.Random(1)
    for _ in range(3000):
        word = "".join(rng.choices("aeiouybdgklmnqrstuvhcfäöüéèîïçñßáíó'", k=rng.randrange(0, 12)))
        stem_ = stemmer(language)(word)
        assert len(stem_) <= len(word.replace("ß", "ss")) + 1 and stem_ == stem_.lower()


def test_unknown_stemmers_are_refused(spark, tenant):
    with pytest.raises(ValueError, match="klingon"):
        FullText(True, "klingon")
    with pytest.raises(ValueError, match="latin"):
        FullText(True, stopwords="latin")
    with pytest.raises(Exception, match="klingon"):
        tenant.query("SELECT stem(author, 'klingon') AS s FROM notes")
    got = tenant.query("SELECT stem('running', 'english') AS a, stem('Häuser', 'none') AS b, stem('kategorien', 'german') AS c, stem('tornados', 'spanish') AS d, stem('maisons', 'french') AS e")["rows"]
    assert got == [{"a": "run", "b": "Häuser", "c": "kategori", "d": "torn", "e": "maison"}]


def test_a_german_index_finds_german_forms(spark):
    df = spark.createDataFrame([(1, "die Häuser der Auffassung"), (2, "ein Haus"), (3, "runs running"), (4, "Auffassungen äpfel"), (5, "Apfel")], "id long, t string")
    found = lambda q, kind: {r.id for r in search.bm25(df, "id", ["t"], q, FullText(True, kind, "none", "[^a-zäöüß]+", False)).collect()}
    assert found("Auffassungen", "german") == {1, 4} and found("run", "german") == {3} and found("Apfel", "german") == {4, 5}
    assert found("run", "porter") == {3}


def test_hash_embedding_has_length_one():
    v = vectors.hash_embedding_of("One two, TWO three")
    assert len(v) == 256 and math.isclose(sum(x * x for x in v), 1.0)
    assert vectors.hash_embedding_of(" ") == [0.0] * 256


def test_similarities(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    got = [tuple(r) for r in df.select(F.round(vectors.cosine_similarity(F.col("a"), F.col("b")), 4), vectors.distance(F.col("a"), F.col("b")), vectors.inner_product(F.col("a"), F.col("b"))).collect()]
    assert got[0] == (0.7071, 1.0, 1.0) and got[1][0] is None


def test_bm25_by_hand(spark):
    df = spark.createDataFrame([(1, "red red blue"), (2, "blue green"), (3, "green")], "id long, t string")
    got = {r.id: r.score for r in search.bm25(df, "id", ["t"], "red blue", FullText(True, "none", "none", "[^a-z]+")).collect()}
    idf = lambda n: math.log(1 + (3 - n + 0.5) / (n + 0.5))
    want = idf(1) * 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * 3 / 2)) + idf(2) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * 3 / 2))
    assert set(got) == {1, 2} and math.isclose(got[1], want, rel_tol=1e-9)


def test_rarest_words_are_counted_within_the_row(spark):
    rows = [(1, "the River river runs runs deep 1234"), (2, None), (3, "a an 77777"), (4, "")]
    got = {r.id: r.words for r in search.rarest_words(spark.createDataFrame(rows, "id long, t string"), "id", "t", 2).collect()}
    assert got == {1: ["deep", "river"]}
    plan = search.rarest_words(spark.createDataFrame(rows, "id long, t string"), "id", "t")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_many_texts_embed_as_each_alone(spark):
    texts = ["One two, TWO three", None, "", "x" * 300 + " y", "a-b a"]
    got = [r.v for r in spark.createDataFrame(list(enumerate(texts)), "id long, t string").orderBy("id").select(vectors.hash_embedding("t", exact=True).alias("v")).collect()]
    assert got == [vectors.hash_embedding_of(t) for t in texts]


def test_stored_terms_give_the_scores_of_the_texts(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    put = lambda lo, hi: store.add_rows("notes", spark.createDataFrame([(k, f"running note {'cats ' * (k % 4)}{k}", "river" if k % 3 else None) for k in range(lo, hi)], "n long, body string, other string"), [ColumnSpec("n", "BIGINT"), ColumnSpec("body", "VARCHAR"), ColumnSpec("other", "VARCHAR")])
    settings = FullText(True, columns=("body", "gone", "other"))
    put(0, 20)
    store.configure("notes", settings)
    for step in (lambda: None, lambda: store.roll_up("notes"), lambda: put(20, 30), lambda: store.forget("notes", store.view("notes").where("n % 7 = 2").select("_row_id")), lambda: store.roll_up("notes"), lambda: store.configure("notes", FullText(True, "none"))):
        step()
        now = store.manifest("notes").full_text
        view = store.view("notes")
        want = {r["_row_id"]: round(r.score, 9) for r in search.bm25(view, "_row_id", ["body", "other"], "cats rivers run", now).collect()}
        terms, sizes = store.keyword_index("notes")
        got = {r["_row_id"]: round(r.score, 9) for r in search.bm25_of(terms, sizes, "_row_id", "cats rivers run", now).collect()}
        assert got == want and got
    assert search.bm25_of(terms, sizes, "_row_id", " ", now).count() == 0
    plan = lambda: search.bm25_of(*store.keyword_index("notes"), "_row_id", "cats", store.manifest("notes").full_text)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(term)" not in plan()
    store.configure("notes", settings)
    assert "PushedFilters: [IsNotNull(term)" in plan()


def test_blocks_that_cannot_hold_a_best_row_are_not_read(spark, tmp_path):
    rng = random.Random(4)
    texts = [(k, " ".join(rng.choices(["red", "blue", "x1", "x2", "x3", "x4"], [1, 2, 90, 90, 90, 90], k=rng.choice([5, 20, 80, 300])))) for k in range(600)] + [(600, None), (601, "")]
    df = spark.createDataFrame(texts, "id long, t string")
    plain = FullText(True, "none", "none", "[^a-z0-9]+", False)
    made = ranked.RankedIndex.build(search.index(df, "id", ["t"], plain), search.lengths(df, "id", ["t"], plain), "id", plain, str(tmp_path / "index"), block_rows=20)
    read = 0
    for words in ("red", "red blue", "blue x1", "nothing", ""):
        scores = sorted(((-round(r.score, 9), r.id) for r in search.bm25(df, "id", ["t"], words, plain).collect()))
        for k in (1, 5, 1000):
            best, figures = made.top(words, k)
            assert [(-r.score, r["row"]) for r in best.collect()] == scores[:k]
            read += figures["blocks"] - figures["read"] if k < 1000 else 0
    assert read > 30
    best, figures = made.top("red", 5)
    assert figures["read"] < figures["blocks"] / 2
    assert "PushedFilters: [IsNotNull(term)" in best._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("small", [False, True])
def test_nearest_of_many_queries_are_those_of_each(spark, monkeypatch, small):
    rng = np.random.default_rng(5)
    if small:
        monkeypatch.setattr(vectors, "BLOCK_BYTES", 8 * 4 * 7)
        monkeypatch.setattr(vectors, "HELD_BYTES", 100)
    rows = [(k, [float(x) for x in rng.integers(-2, 3, 4)]) for k in range(300)] + [(300, None), (301, [1.0]), (302, []), (None, [1.0, 0.0, 0.0, 0.0]), (303, [0.0] * 4)]
    asked = [(f"q{k}", v) for k, (_, v) in enumerate(rows[::9])] + [("none", None)]
    got = vectors.nearest_of_many(spark.createDataFrame(rows, "id int, v array<float>").repartition(4), "v", "id", spark.createDataFrame(asked, "q string, w array<double>"), "w", "q", 5, 4).collect()
    unit = lambda v: np.array(v) / np.linalg.norm(v) if v and len(v) == 4 and any(v) else None
    want = {}
    for q, w in asked:
        if unit(w) is not None:
            scores = sorted((-round(float(unit(w) @ unit(v)), 9), k) for k, v in rows if k is not None and unit(v) is not None)[:5]
            want |= {(q, r): (k, -s) for r, (s, k) in enumerate(scores, 1)}
    assert {(r.query, r.rank): (r.row, r.score) for r in got} == want
