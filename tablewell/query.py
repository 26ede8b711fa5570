"""Queries of tenants: SQL, text, or both; pages with cursors; errors sorted into the caller's and others."""

from __future__ import annotations

import base64
import contextvars
import datetime
import decimal
import hashlib
import json
import re
import threading
import uuid

from pyspark.errors import AnalysisException, ArithmeticException, NumberFormatException, ParseException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import gate
from .functions import search, vectors
from .names import RAW, ROW_ID, VECTOR_SUFFIX
from .session import tenant_session
from .store import Store

DEFAULT_ROWS, MOST_ROWS, MOST_OFFSET, SECONDS = 1000, 10_000, 100_000, 15
MOST_SQL, MOST_TEXT = 20_000, 4_000
LAST_SECONDS = 2
"""How long a cancelled query may take to end before its caller hears of it."""
QUERY_VECTOR = "CAST(:q AS ARRAY<FLOAT>)"
_MATCH = re.compile(r"fts_main_(\w+)\.match_bm25\(\s*(?:\w+\.)?_row_id\s*,\s*('(?:[^']|'')*')\s*\)", re.I)
_SCORE = r"bm25_\d+__"
_COLUMNS = r"\bCOLUMNS\(\s*('(?:[^']|'')*')\s*\)"
CALLERS_FAULT = (AnalysisException, ParseException, ArithmeticException, NumberFormatException, gate.Refused, ValueError, LookupError)


def fingerprint(sql: str | None, text: str | None, table: str | None, column: str | None) -> str:
    return hashlib.sha256(json.dumps([sql, text, table, column]).encode()).hexdigest()[:16]


def cursor(offset: int, of: str) -> str:
    return base64.urlsafe_b64encode(json.dumps({"o": offset, "h": of}).encode()).decode().rstrip("=")


def offset_of(token: str | None, of: str) -> int:
    """The offset of a cursor; Refused if it belongs to another query."""
    if token is None:
        return 0
    try:
        d = json.loads(base64.urlsafe_b64decode(token + "=" * (-len(token) % 4)))
        offset, whose = d["o"], d["h"]
    except Exception as e:
        raise gate.Refused("the cursor can't be read") from e
    if whose != of or not isinstance(offset, int) or not 0 <= offset <= MOST_OFFSET:
        raise gate.Refused("the cursor belongs to another query or goes too far")
    return offset


_PLAIN = re.compile(r"""'(?:[^']|'')*'|"(?:[^"]|"")*"|--[^\n]*|/\*.*?\*/""", re.S)
# The clauses of a SELECT in their order.
CLAUSES = ("select", "from", "where", "group", "having", "qualify", "window", "order", "limit", "offset", "union", "intersect", "except")


def shadow(sql: str) -> str:
    """The statement with literals, quoted names and comments blanked, so that places in it stay the same."""
    return _PLAIN.sub(lambda m: m[0][0] + "\0" * (len(m[0]) - 2) + m[0][-1] if m[0][0] in "'\"" else " " * len(m[0]), sql)


def _in_code(pattern: str, sql: str, to) -> str:  # noqa: ANN001
    """`pattern` replaced wherever it begins outside of literals and comments."""
    seen = shadow(sql)
    out, at = [], 0
    for m in re.finditer(pattern, sql, re.I):
        if m.start() >= at and seen[m.start()] == sql[m.start()]:
            out += [sql[at : m.start()], to(m)]
            at = m.end()
    return "".join(out) + sql[at:]


def rewritten(sql: str) -> str:
    """The documented idioms that Spark spells otherwise: EXCLUDE, $q, information_schema."""
    sql = _in_code(r"\*\s+EXCLUDE\s*\(", sql, lambda m: "* EXCEPT (")
    sql = _in_code(r"\binformation_schema\s*\.\s*(columns|tables)\b", sql, lambda m: f"information_schema_{m[1].lower()}")
    return _in_code(r"\$q\b", sql, lambda m: QUERY_VECTOR)


def clauses(sql: str) -> dict[str, tuple[int, int]]:
    """Where the clauses of the outermost SELECT stand: from its keyword to the next one."""
    seen, depth, found = shadow(sql), 0, []
    for m in re.finditer(r"[()]|[a-z_]+", seen, re.I):
        depth += (m[0] == "(") - (m[0] == ")")
        if not depth and m[0].lower() in CLAUSES and (m[0].lower() != "except" or not re.search(r"\*\s*$", seen[: m.start()])):
            found.append((m[0].lower(), m.start()))
    return {name: (at, end) for (name, at), (_, end) in zip(found, [*found[1:], ("", len(sql.rstrip().rstrip(";")))], strict=True)}


HELD = "held__"


def held_condition(sql: str, clause: str) -> str | None:
    """The statement with the condition of a clause as a further column of an inner SELECT, on which an outer one filters.

    There, names of other columns of the select list and window functions may be used. None if it has no such clause.
    """
    at = clauses(sql)
    if clause not in at or "select" not in at or {"union", "intersect", "except"} & set(at):
        return None
    text = lambda name: sql[slice(*at[name])].strip() if name in at else ""
    condition = text(clause)[len(clause) :].strip()
    inner = [f"{text('select')}, ({condition}) AS {HELD}", *(text(c) for c in ("from", "where", "group", "having", "window") if c != clause)]
    outer = [text(c) for c in ("order", "limit", "offset")]
    before = sql[: at["select"][0]]
    return " ".join(x for x in (f"{before}SELECT * EXCEPT ({HELD}) FROM ({' '.join(x for x in inner if x)}) WHERE {HELD}", *outer) if x)


def rendered(value: object, kind: str = "") -> object:
    """A value as JSON has it: BIGINT as text, times as text."""
    if kind == "bigint" and value is not None:
        return str(value)
    if isinstance(value, datetime.datetime):
        return value.strftime("%Y-%m-%d %H:%M:%S")
    if isinstance(value, (datetime.date, decimal.Decimal)):
        return str(value)
    return value


class Tenant:
    """One store, queried by SQL over its tables' views."""

    def __init__(self, store: Store, embed=None, model: str = "hash-bow-v1") -> None:  # noqa: ANN001
        self.store, self.embed, self.model = store, embed or vectors.hash_embedding_of, model

    def _same_space(self, table: str) -> None:
        """Refused, unless the table's vectors are of the model that texts are embedded by."""
        m = self.store.manifest(table)
        if m.dims and m.model != self.model:
            raise gate.Refused(f"table {table} holds vectors of {m.model}, but texts are embedded by {self.model}")

    def _views(self, spark: SparkSession, sql: str, text: bool = False) -> None:
        """Views of the tables that the statement names, and only these; vectors only where a vector column is named."""
        named = {r.lower() for r in gate.relations(spark, sql)}
        own = Store(spark, self.store.root, self.store.now)
        for table in own.tables():
            if table in named:
                m = own.manifest(table)
                wanted = any(re.search(rf"\b{c}{VECTOR_SUFFIX}\b", sql) for c in m.embedded())
                if wanted and text:
                    self._same_space(table)
                view = own.view(table, vectors=wanted)
                for c in m.embedded():
                    if c + VECTOR_SUFFIX in view.columns:
                        view = view.withMetadata(c + VECTOR_SUFFIX, {"vector_dims": m.dims})
                view.createOrReplaceTempView(table)
        self._catalogue(spark, own)

    @staticmethod
    def _catalogue(spark: SparkSession, store: Store) -> None:
        rows = [(t, c.name, c.type, k) for t in store.tables() for k, c in enumerate(store.manifest(t).columns, 1)]
        spark.createDataFrame(rows, "table_name string, column_name string, data_type string, ordinal_position int").createOrReplaceTempView("information_schema_columns")
        spark.createDataFrame([(t,) for t in store.tables()], "table_name string").createOrReplaceTempView("information_schema_tables")

    def _matches(self, spark: SparkSession, sql: str) -> str:
        """match_bm25 calls become a column of scores that is joined to the table."""
        made: list[str] = []

        def score(m: re.Match) -> str:
            table, words = m[1].lower(), m[2][1:-1].replace("''", "'")
            settings = self.store.manifest(table).full_text
            if not settings.enabled:
                raise gate.Refused(f"table {table} has no full-text index")
            view, name = spark.table(table), f"bm25_{len(made)}__"
            made.append(name)
            terms, sizes = Store(spark, self.store.root, self.store.now).keyword_index(table)
            scores = search.bm25_of(terms, sizes, ROW_ID, words, settings).withColumnRenamed("score", name)
            view.join(scores, ROW_ID, "left").createOrReplaceTempView(table)
            # the bare column is only seen by `*`, which leaves it out
            return f"coalesce({name})"

        return _in_code(_MATCH.pattern, sql, score)

    def _columns(self, spark: SparkSession, sql: str) -> str:
        """COLUMNS('pattern') becomes the columns of the statement's tables whose names match, vectors left out."""

        def listed(m: re.Match) -> str:
            pattern = re.compile(m[1][1:-1].replace("''", "'"))
            names = [c for t in sorted(gate.relations(spark, _in_code(_COLUMNS, sql, lambda _: "1"))) if spark.catalog.tableExists(t) for c in spark.table(t).columns]
            found = [f"`{c}`" for c in dict.fromkeys(names) if pattern.search(c) and not c.endswith(VECTOR_SUFFIX)]
            if not found:
                raise gate.Refused(f"no column matches {m[1][:60]}")
            return ", ".join(found)

        return _in_code(_COLUMNS, sql, listed)

    def _summary(self, spark: SparkSession, table: str) -> DataFrame:
        """A row for each column of a table: its type, values and nulls, distinct values (approximately), and least and greatest
        value; of numbers also mean, spread (of a sample) and quartiles (approximate). All are one aggregation."""
        if table not in self.store.tables():
            raise gate.Refused(f"there is no table {table[:80]}")
        view = Store(spark, self.store.root, self.store.now).view(table)
        nothing = F.lit(None).cast("string")

        def of(name: str, kind: str) -> Column:
            c = F.col(f"`{name}`")
            figures = dict.fromkeys(("avg", "std", "q25", "q50", "q75"), nothing)
            if kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal"):
                figures = {"avg": F.avg(c), "std": F.stddev_samp(c), **{f"q{n}": F.percentile_approx(c, n / 100) for n in (25, 50, 75)}}
            figures = {"min": F.min(c), "max": F.max(c), "approx_unique": F.approx_count_distinct(c), **figures, "count": F.count(c), "nulls": F.count_if(c.isNull())}
            whole = ("approx_unique", "count", "nulls")
            return F.struct(F.lit(name).alias("column_name"), F.lit(kind).alias("column_type"), *((v if k in whole else v.cast("string")).alias(k) for k, v in figures.items()))

        own = [of(c, kind) for c, kind in view.dtypes if not c.startswith("_")]
        return view.agg(F.array(*own).alias("s")).select(F.explode("s").alias("s")).select("s.*")

    def ranking(self, text_table: str | None, text_column: str | None) -> tuple[str, str]:
        """The table and column that a text is compared with: those named, else the only embedded one."""
        found = [(t, c) for t in self.store.tables() for c in self.store.manifest(t).embedded() if text_table in (None, t) and text_column in (None, c)]
        if len(found) != 1:
            raise gate.Refused(f"name a table and column; embedded ones are: {', '.join('.'.join(f) for f in found) or 'none'}")
        return found[0]

    def frame(self, sql: str | None = None, text: str | None = None, table: str | None = None, column: str | None = None, limit: int = DEFAULT_ROWS) -> DataFrame:
        """The checked, lazy result of a query."""
        if not sql and not text:
            raise gate.Refused("a query needs sql or text")
        if len(sql or "") > MOST_SQL or len(text or "") > MOST_TEXT:
            raise gate.Refused("the query is too long")
        spark = tenant_session(self.store.spark)
        vectors.register(spark)
        q = self.embed(text) if text else None
        if sql and (m := re.fullmatch(r"\s*summarize\s+(\w+)\s*;?\s*", sql, re.I)):
            return self._summary(spark, m[1].lower())
        if not sql:
            table, column = self.ranking(table, column)
            self._same_space(table)
            hidden = [c + VECTOR_SUFFIX for c in self.store.manifest(table).embedded()] + [RAW] * self.store.manifest(table).raw
            sql = f"SELECT * EXCEPT ({', '.join(hidden)}), array_cosine_similarity({column}{VECTOR_SUFFIX}, {QUERY_VECTOR}) AS score FROM {table} WHERE {column}{VECTOR_SUFFIX} IS NOT NULL ORDER BY score DESC, {ROW_ID} LIMIT {int(limit)}"
            own = Store(spark, self.store.root, self.store.now)
            if not own.manifest(table).dims:
                raise gate.Refused(f"table {table} has no vectors yet")
            view = own.view(table, vectors=True)
            for c in own.manifest(table).embedded():
                view = view.withMetadata(c + VECTOR_SUFFIX, {"vector_dims": own.manifest(table).dims})
            view.createOrReplaceTempView(table)
            self._catalogue(spark, own)
        else:
            sql = rewritten(sql)
            if gate.opener(sql) not in gate.OPENERS:
                gate.check(spark, sql, set())
            sql = held_condition(sql, "qualify") or sql
            named = _in_code(_COLUMNS, sql, lambda _: "1")
            self._views(spark, named, bool(text))
            sql = self._matches(spark, self._columns(spark, sql))
        search.register(spark)
        df = self._checked(spark, sql, q)
        gate.check_vectors(df)
        shown = [f.name for f in df.schema if "vector_dims" not in f.metadata and not re.fullmatch(_SCORE, f.name)]
        if not shown:
            raise gate.Refused("every column of the result is a vector, which are withheld")
        if not any(re.search(_SCORE, c) for c in df.columns):
            return df.select(*(F.col(f"`{c}`") for c in shown)) if len(shown) < len(df.columns) else df
        return df.select(*(F.col(f"`{c}`").alias(re.sub(rf"coalesce\({_SCORE}\)", "match_bm25", c)) for c in shown))

    def _checked(self, spark: SparkSession, sql: str, q: list[float] | None) -> DataFrame:
        """The statement's frame; if a name in WHERE is that of a column of its own select list, with the condition held."""
        functions = set(gate.SIMILARITIES) | {"stem", "jaro_winkler_similarity"}

        def made(text: str) -> DataFrame:
            gate.check(spark, text, {*self.store.tables(), "information_schema_columns", "information_schema_tables"}, functions)
            return spark.sql(text, args={"q": F.array(*(F.lit(float(x)) for x in q))} if q is not None and ":q" in text else None)

        try:
            return made(sql)
        except AnalysisException as e:
            # an aggregate or a window would see rows that WHERE should have taken away
            held = held_condition(sql, "where") if "UNRESOLVED_COLUMN" in (e.getCondition() or "") and not re.search(r"\bdistinct\b", shadow(sql), re.I) else None
            if held is None:
                raise
            df = made(held)
            if gate.computes_over_rows(df, HELD):
                raise
            return df

    def page(self, sql: str | None = None, text: str | None = None, table: str | None = None, column: str | None = None, limit: int = DEFAULT_ROWS, after: str | None = None) -> DataFrame:
        """The rows of a page as a lazy frame, with their types."""
        offset, cap = offset_of(after, fingerprint(sql, text, table, column)), max(1, min(limit, MOST_ROWS))
        return self.frame(sql, text, table, column, min(MOST_ROWS, offset + cap)).offset(offset).limit(cap)

    def query(self, sql: str | None = None, text: str | None = None, table: str | None = None, column: str | None = None, limit: int = DEFAULT_ROWS, after: str | None = None, seconds: float = SECONDS) -> dict:
        """A page of rows, whether it was cut, and the cursor of the next page."""
        whose = fingerprint(sql, text, table, column)
        offset, cap = offset_of(after, whose), max(1, min(limit, MOST_ROWS))
        df = self.frame(sql, text, table, column, min(MOST_ROWS, offset + cap + 1))
        kinds = dict(df.dtypes)
        got = self._timed(df.offset(offset).limit(cap + 1), seconds)
        rows = [{c: rendered(v, kinds[c]) for c, v in r.asDict().items()} for r in got[:cap]]
        more = len(got) > cap
        return {"rows": rows, "truncated": more, "cursor": cursor(offset + cap, whose) if more and offset + cap <= MOST_OFFSET else None}

    @staticmethod
    def _timed(df: DataFrame, seconds: float) -> list:
        """The rows, unless it takes too long: then its jobs are cancelled, those too that Spark has yet to submit."""
        context = df.sparkSession.sparkContext
        group, out = f"query-{uuid.uuid4().hex}", {}

        def work() -> None:
            context.setJobGroup(group, "query", True)
            try:
                out["rows"] = df.collect()
            except Exception as e:  # handed to the caller below
                out["error"] = e

        t = threading.Thread(target=contextvars.copy_context().run, args=(work,), daemon=True)
        t.start()
        t.join(seconds)
        if t.is_alive():
            # a query in planning, or between its jobs, has none to cancel yet; Spark keeps the group's name for those to come
            context._jsc.sc().cancelJobGroupAndFutureJobs(group)
            t.join(LAST_SECONDS)
            raise TimeoutError(f"the query took more than {seconds} s") from out.get("error")
        if "error" in out:
            raise out["error"]
        return out["rows"]


def is_callers_fault(error: Exception) -> bool:
    """Whether an error comes from the statement or the data it names, and not from the engine."""
    if isinstance(error, CALLERS_FAULT):
        return True
    return isinstance(error, PySparkException) and bool(re.match(r"CAST_|DIVIDE_BY_ZERO|INVALID_|ARITHMETIC|UNRESOLVED|USER_RAISED", error.getCondition() or ""))
