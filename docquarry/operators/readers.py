"""Read-only access: SQL over allowed tables, memo search, tools over features, health."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.operators import lexical, retrieval
from docquarry.session import shared_dir

#: Functions of the engine that run other code or read files.
_REFUSED_FUNCTIONS = frozenset("reflect java_method try_reflect read_files input_file_name".split())
#: Table functions that only make rows of their arguments.
_TABLE_FUNCTIONS = frozenset("explode explode_outer posexplode posexplode_outer inline inline_outer stack range".split())


def _named(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _check(node, allowed: frozenset[str], builtin, ident, command) -> None:
    """Raises unless all that a parsed plan (or expression) reads is among ``allowed`` names or common table expressions in their scope,
    and all that it calls is an ordinary function of the engine."""
    what = node.getClass().getSimpleName()
    if what == "UnresolvedRelation":
        parts = _named(node.multipartIdentifier())
        if len(parts) != 1 or parts[0].lower() not in allowed:
            raise PermissionError(f"not allowed: {'.'.join(parts)}")
    elif what == "UnresolvedWith":
        for pair in _named(node.cteRelations()):
            _check(pair._2(), allowed | ({pair._1().lower()} if node.allowRecursion() else set()), builtin, ident, command)
            allowed = allowed | {pair._1().lower()}
        _check(node.child(), allowed, builtin, ident, command)
        return
    elif what in ("UnresolvedFunction", "UnresolvedTableValuedFunction"):
        parts = _named(node.nameParts() if what == "UnresolvedFunction" else node.name())
        name = parts[-1].lower()
        known = name in _TABLE_FUNCTIONS if what != "UnresolvedFunction" else builtin.functionExists(ident(name)) and name not in _REFUSED_FUNCTIONS
        if len(parts) != 1 or not known:
            raise PermissionError(f"function not allowed: {'.'.join(parts)}")
    elif command.isInstance(node) or "Compound" in what or "UnresolvedIdentifier" in what or (what.startswith(("Unresolved", "ScriptTransformation", "InsertInto")) and what not in _PLAIN):
        raise PermissionError(f"only one SELECT is allowed, not {what}")
    inner = [*_named(node.children())]
    if _has(node, "expressions"):
        inner += [*_named(node.expressions())]
    elif _has(node, "plan"):
        inner.append(node.plan())
    for x in inner:
        _check(x, allowed, builtin, ident, command)


#: Nodes of a parsed SELECT that name nothing outside it.
_PLAIN = frozenset(
    "UnresolvedAttribute UnresolvedStar UnresolvedAlias UnresolvedInlineTable UnresolvedSubqueryColumnAliases UnresolvedHaving UnresolvedRegex UnresolvedExtractValue UnresolvedOrdinal "
    "UnresolvedNamedLambdaVariable UnresolvedStarExceptOrReplace UnresolvedGenerator UnresolvedWindowExpression".split()
)


def _has(node, method: str) -> bool:
    """Whether a node of the engine's tree has a method without arguments of that name."""
    return any(m.getName() == method and not m.getParameterCount() for m in node.getClass().getMethods())


def read_only_sql(spark: SparkSession, sql: str, tables: dict[str, DataFrame]) -> DataFrame:
    """The rows of one SELECT (or WITH) over ``tables``, by name. The engine parses it; what the parsed plan reads or calls besides, by
    whatever syntax, is refused before anything runs: other tables and views, files by path, commands, functions that aren't the engine's."""
    text = sql.strip().rstrip(";").strip()
    jvm = spark._jvm
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(f"select * from ({text}\n)")  # only a query may stand there
    except Exception as e:  # the parser's own message
        raise PermissionError(f"only one SELECT is allowed: {str(e).splitlines()[0]}") from None
    builtin = jvm.org.apache.spark.sql.catalyst.analysis.FunctionRegistry.builtin()
    _check(plan, frozenset(t.lower() for t in tables), builtin, jvm.org.apache.spark.sql.catalyst.FunctionIdentifier, jvm.java.lang.Class.forName("org.apache.spark.sql.catalyst.plans.logical.Command"))
    # each table goes in under its name as a frame, so that no view is made, and names in ``sql`` mean nothing else
    own = ", ".join(f"`{name}` as (select * from {{t{i}}})" for i, name in enumerate(tables))
    body = text.replace("{", "{{").replace("}", "}}")
    return spark.sql(f"with {own} select * from ({body}\n)" if tables else body, **{f"t{i}": t for i, t in enumerate(tables.values())})


def memo_search(memos: DataFrame, queries: DataFrame, k: int, status: tuple[str, ...] = ("approved",)) -> DataFrame:
    """The ``k`` best memos (memo_id, text, status) of those statuses for each query (query_id, text), by BM25 over all memos."""
    terms = queries.select("query_id", F.explode(retrieval.terms(F.col("text"))).alias("term")).distinct()
    scope = memos.where(F.col("status").isin(*status)).select("memo_id").distinct()
    return lexical.index_of(memos, shared_dir(memos.sparkSession), "memo_id").search(terms, k, scope).rows


#: What a check may say, worst last.
STATUSES = ("ok", "warn", "error")


def worst(checks: DataFrame, group: str) -> DataFrame:
    """(group, status, failing): the worst status of each group's checks (name, status), and the names of those that aren't ok. A status
    of another name counts as an error."""
    rank = F.when(F.col("status") == "ok", 0).when(F.col("status") == "warn", 1).otherwise(2)
    got = checks.groupBy(group).agg(F.max(rank).alias("r"), F.array_join(F.array_sort(F.collect_set(F.when(rank > 0, F.col("name")))), ",").alias("failing"))
    return got.select(group, F.get(F.array(*map(F.lit, STATUSES)), F.col("r")).alias("status"), "failing")


def iso_date(c):
    """A date as year-month-day; null where it isn't one."""
    return F.date_format(F.try_to_timestamp(c.cast("string")).cast("date"), "yyyy-MM-dd")


def trailing_period(name):
    """(year, quarter) that a name like ``x_2024_q3`` or ``x_2024`` ends in; nulls where it doesn't, or the year is outside 1900 to 2100."""
    year = F.try_to_number(F.nullif(F.regexp_extract(name, r"_((?:19|20)\d\d|2100)(?:_q[1-4])?$", 1), F.lit("")), F.lit("9999")).cast("int")
    quarter = F.try_to_number(F.nullif(F.regexp_extract(name, r"_(?:(?:19|20)\d\d|2100)_q([1-4])$", 1), F.lit("")), F.lit("9")).cast("int")
    return F.struct(year.alias("year"), quarter.alias("quarter"))


def transcript_problems(ticker, year, quarter, when, prepared, answers):
    """Names of the fields that a transcript may not have so: either part of its text may be empty, but neither missing."""
    bad = {
        "ticker": ~F.coalesce(F.rlike(ticker, F.lit(r"\A[A-Z][A-Z0-9.\-]{0,7}\z")), F.lit(False)), "year": ~F.coalesce(year.between(1900, 2100), F.lit(False)),
        "quarter": ~F.coalesce(quarter.between(1, 4), F.lit(False)), "event_datetime": ~F.coalesce(F.rlike(when, F.lit(r"(?:Z|[+-]\d\d:?\d\d)\z")) & F.try_to_timestamp(when).isNotNull(), F.lit(False)),
        "prepared_remarks": prepared.isNull(), "q_and_a": answers.isNull(),
    }
    return F.array_compact(F.array(*[F.when(b, F.lit(n)) for n, b in bad.items()]))
