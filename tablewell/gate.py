"""What a tenant's statement may be: one SELECT over known tables, with known functions, that lets no vector out.

Spark parses and analyses; this module only looks at the plans. Functions are allowed by a list of groups and names, because
Spark has some that run any code.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from .names import VECTOR_SUFFIX

OPENERS = ("select", "with", "from", "values", "table", "describe", "summarize", "(")
TABLE_FUNCTIONS = ("range", "explode", "posexplode", "inline", "explode_outer", "posexplode_outer", "generate_series")
SIMILARITIES = ("array_cosine_similarity", "array_cosine_distance", "array_distance", "array_inner_product", "array_negative_inner_product", "array_dot_product", "array_negative_dot_product")
# The groups of built-in functions that are allowed, as Spark names them, and single ones of other groups.
GROUPS = frozenset(
    "agg_funcs array_funcs bitwise_funcs collection_funcs conditional_funcs conversion_funcs datetime_funcs generator_funcs hash_funcs json_funcs lambda_funcs map_funcs "
    "math_funcs predicate_funcs string_funcs struct_funcs url_funcs variant_funcs window_funcs".split()
)
ALLOWED = frozenset("typeof equal_null bitmap_count".split())
# Functions of these groups that are not allowed all the same.
REFUSED = frozenset(
    "reflect java_method try_reflect input_file_name input_file_block_start input_file_block_length current_user user session_user "
    "current_catalog current_database current_schema version spark_partition_id raise_error assert_true session_window_internal "
    "python_worker_logs".split()
)
_COMMENT = re.compile(r"--[^\n]*|/\*.*?\*/", re.S)
_COMMANDS = re.compile(r"Command|Insert|Create|Drop|Alter|Delete|Update|Merge|CompoundBody|SetCatalog|Truncate|Load|Cache|Refresh|Analyze|ScriptTransformation|Explain|Replace|Recover|Repair|Grant|Revoke|Call|WriteTo|OverwriteBy|AppendData")


class Refused(ValueError):
    """A statement that isn't allowed; the message says why."""


def opener(sql: str) -> str:
    """The first word (or bracket) of a statement, comments left out."""
    m = re.match(r"\s*(\(|[a-z]+)", _COMMENT.sub(" ", sql), re.I)
    return m[1].lower() if m else ""


def _nodes(plan) -> Iterator:  # noqa: ANN001
    """Every node of a plan with those of its subqueries."""
    todo = [plan]
    while todo:
        node = todo.pop()
        yield node
        for group in (node.children(), node.innerChildren(), node.subqueries()):
            it = group.iterator()
            while it.hasNext():
                child = it.next()
                if hasattr(child, "subqueries"):
                    todo.append(child)


def _expressions(plan) -> Iterator:  # noqa: ANN001
    for node in _nodes(plan):
        todo = []
        it = node.expressions().iterator()
        while it.hasNext():
            todo.append(it.next())
        while todo:
            e = todo.pop()
            yield e
            it = e.children().iterator()
            while it.hasNext():
                todo.append(it.next())


def _kind(node) -> str:  # noqa: ANN001
    return node.getClass().getSimpleName()


def _parsed(spark: SparkSession, sql: str):  # noqa: ANN202
    try:
        return spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as e:
        raise Refused(f"the statement can't be parsed: {str(e).splitlines()[0][:200]}") from e


def relations(spark: SparkSession, sql: str) -> set[str]:
    """Names of the relations of a statement, CTEs among them."""
    return {str(n.multipartIdentifier().mkString(".")) for n in _nodes(_parsed(spark, sql)) if _kind(n) == "UnresolvedRelation"}


def _ctes(plan) -> set[str]:  # noqa: ANN001
    out = set()
    for n in _nodes(plan):
        if _kind(n) == "UnresolvedWith":
            it = n.cteRelations().iterator()
            while it.hasNext():
                out.add(str(it.next()._1()).lower())
    return out


_groups: dict[str, str] = {}


def _group_of(spark: SparkSession, name: str) -> str:
    """The group of a built-in function, asked once; empty if there is none of the name."""
    if name not in _groups:
        jvm = spark.sparkContext._jvm
        found = jvm.org.apache.spark.sql.catalyst.analysis.FunctionRegistry.builtin().lookupFunction(jvm.org.apache.spark.sql.catalyst.FunctionIdentifier(name))
        _groups[name] = str(found.get().getGroup()) if found.isDefined() else ""
    return _groups[name]


def check(spark: SparkSession, sql: str, tables: set[str], functions: set[str] = frozenset()) -> None:
    """Refused, unless the statement is one SELECT over `tables` whose functions are built-in and harmless, or named."""
    word = opener(sql)
    if word not in OPENERS:
        raise Refused(f"a statement begins with {', '.join(OPENERS)}; this one begins with {word or 'nothing'!r}")
    plan = _parsed(spark, sql)
    known = {t.lower() for t in tables} | _ctes(plan)
    allowed = {f.lower() for f in functions}
    for node in _nodes(plan):
        kind = _kind(node)
        if _COMMANDS.search(kind):
            raise Refused(f"only a SELECT is allowed, not {kind}")
        if kind == "UnresolvedRelation":
            name = str(node.multipartIdentifier().mkString(".")).lower()
            if name not in known:
                raise Refused(f"there is no table {name[:80]}")
        if kind == "UnresolvedTableValuedFunction":
            name = str(node.name().mkString(".")).lower()
            if name not in TABLE_FUNCTIONS:
                raise Refused(f"table function {name[:80]} is not allowed")
        if kind == "UnresolvedSubqueryColumnAliases" and VECTOR_SUFFIX in str(node.outputColumnNames().mkString(" ")).lower():
            raise Refused(f"a name that ends in {VECTOR_SUFFIX} is kept for vectors")
    for e in _expressions(plan):
        if _kind(e) == "Alias" and str(e.name()).lower().endswith(VECTOR_SUFFIX):
            raise Refused(f"a name that ends in {VECTOR_SUFFIX} is kept for vectors")
        if _kind(e) == "UnresolvedFunction":
            name = str(e.nameParts().mkString(".")).lower()
            if name in SIMILARITIES:
                _check_arguments(name, e)
            if name not in allowed | ALLOWED and (name in REFUSED or _group_of(spark, name) not in GROUPS):
                raise Refused(f"function {name[:80]} is not allowed")


def _check_arguments(name: str, call) -> None:  # noqa: ANN001
    """A similarity compares vector columns with each other or with the query's vector, not with numbers of one's choice."""
    it = call.arguments().iterator()
    while it.hasNext():
        a = it.next()
        inner = a.child() if _kind(a) == "Cast" else a
        column = _kind(inner) == "UnresolvedAttribute" and str(inner.nameParts().last()).lower().endswith(VECTOR_SUFFIX)
        if not column and not (_kind(inner) == "NamedParameter" and str(inner.name()) == "q"):
            raise Refused(f"{name} compares vector columns and $q only")


def computes_over_rows(df: DataFrame, column: str) -> bool:
    """Whether the select list that makes this column holds aggregates or windows."""
    for node in _nodes(df._jdf.queryExecution().analyzed()):
        if any(_kind(e) == "Alias" and str(e.name()) == column for e in _each(node.expressions())):
            # Spark puts a list that names its own aggregates over the aggregation, as projections
            while _kind(node) == "Project":
                node = node.child()
            return _kind(node) in ("Aggregate", "Window")
    return False


def _each(sequence) -> Iterator:  # noqa: ANN001
    it = sequence.iterator()
    while it.hasNext():
        yield it.next()


def _vector_ids(plan) -> set[int]:  # noqa: ANN001
    """Ids of the columns that are vectors: those marked, and names for them, casts left aside."""
    ids, names = set(), []
    for node in _nodes(plan):
        it = node.output().iterator()
        while it.hasNext():
            a = it.next()
            if a.metadata().contains("vector_dims"):
                ids.add(int(a.exprId().id()))
    for e in _expressions(plan):
        if _kind(e) == "Alias":
            child = e.child()
            while _kind(child) == "Cast":
                child = child.child()
            if _kind(child) == "AttributeReference":
                names.append((int(child.exprId().id()), int(e.exprId().id())))
    before = -1
    while before != len(ids):
        before = len(ids)
        ids |= {name for of, name in names if of in ids}
    return ids


def check_vectors(df: DataFrame) -> None:
    """Refused if a vector column is used otherwise than in a similarity, in IS [NOT] NULL or as a bare select item."""
    plan = df._jdf.queryExecution().analyzed()
    vectors = _vector_ids(plan)
    if not vectors:
        return
    it = plan.output().iterator()
    while it.hasNext():
        a = it.next()
        if int(a.exprId().id()) in vectors and not a.metadata().contains("vector_dims"):
            raise Refused("a vector may not be cast")
    for node in _nodes(plan):
        if _kind(node) in ("Union", "Intersect", "Except", "Distinct", "Pivot", "Deduplicate"):
            it = node.output().iterator()
            while it.hasNext():
                if int(it.next().exprId().id()) in vectors:
                    raise Refused("a vector may not go through a set operation")
        it = node.expressions().iterator()
        while it.hasNext():
            _check_expression(it.next(), vectors, True)


def _check_expression(e, vectors: set[int], top: bool) -> bool:  # noqa: ANN001
    """Whether the expression is a vector; Refused if it makes something else of one."""
    kind = _kind(e)
    if kind == "AttributeReference":
        return int(e.exprId().id()) in vectors
    if kind == "Alias" and top and int(e.exprId().id()) in vectors:
        return True
    if kind == "SQLScalarFunction" and str(e.toString()).split("(")[0].rpartition(".")[2] in SIMILARITIES:
        return False
    held = []
    it = e.children().iterator()
    while it.hasNext():
        held.append(_check_expression(it.next(), vectors, False))
    if not any(held) or kind in ("IsNull", "IsNotNull"):
        return False
    raise Refused("a vector may only be compared with another one or be tested for NULL")


def check_predicate(spark: SparkSession, predicate: str) -> None:
    """Refused, unless the text is one expression without subqueries, with balanced brackets and quotes."""
    depth, quote = 0, ""
    for c in predicate:
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"`":
            quote = c
        elif c == ";":
            raise Refused("a predicate holds no ;")
        elif c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
            if depth < 0:
                raise Refused("a bracket closes that none opened")
    if depth or quote or not predicate.strip():
        raise Refused("brackets or quotes of the predicate aren't balanced")
    if _COMMENT.search(predicate):
        raise Refused("a predicate holds no comments")
    check(spark, f"SELECT 1 FROM t WHERE ({predicate})", {"t"})
    if re.search(r"\bselect\b", predicate, re.I):
        raise Refused("a predicate holds no subquery")
