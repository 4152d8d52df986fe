"""Guarded ad-hoc SQL: one SELECT over registered views, by default at most 20 rows."""

from __future__ import annotations

import logging
import re
import uuid
from collections.abc import Iterable, Iterator, Mapping

from pyspark.errors import ParseException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROW_CAP = 20
DEFAULT_VIEW = "df_merged"

# The answers a caller may match on
ONLY_SELECT = "ERRO: somente consultas SELECT são permitidas."
ONE_STATEMENT = "ERRO: múltiplas instruções SQL não são permitidas."
NO_ROWS = "Nenhum dado encontrado."
SQL_ERROR_PREFIX = "SQL_ERROR: "

# Functions that call arbitrary Java methods, and those that tell where the data lies
_REFUSED_CALLS = {
    "reflect", "try_reflect", "java_method",
    "input_file_name", "input_file_block_start", "input_file_block_length",
}
_FILE_COLUMN = "_metadata"

# All that a query's relations and clauses may be made of. Table functions, inline tables,
# lateral views and whatever a later version of the parser adds are not among them.
_PLAN_NODES = {
    "Project", "Aggregate", "Filter", "Join", "Sort", "GlobalLimit", "LocalLimit", "Offset",
    "Distinct", "Union", "Intersect", "Except", "SubqueryAlias", "UnresolvedRelation",
    "UnresolvedSubqueryColumnAliases", "UnresolvedHaving", "WithWindowDefinition", "UnresolvedWith",
    "UnresolvedHint", "RepartitionByExpression", "Repartition", "OneRowRelation", "Sample",
    "Pivot", "Unpivot",
}

# Aggregates whose one value grows with the rows of its group
_GATHERING = {"CollectList", "CollectSet", "ListAgg", "CollectTopK", "HistogramNumeric"}

# Joins that compare every row of one side with every row of the other
_ALL_PAIRS = {"CartesianProductExec", "BroadcastNestedLoopJoinExec"}

# What an answer may take at most, whatever its rows hold
VALUE_LIMIT_BYTES = 1 << 20

# What may stand above the select list of a query, besides the list itself
_ABOVE_SELECT = {
    "GlobalLimit", "LocalLimit", "Offset", "Sort", "Distinct", "UnresolvedHaving",
    "WithWindowDefinition", "Union", "Intersect", "Except", "SubqueryAlias", "UnresolvedHint",
    "RepartitionByExpression", "Repartition", "UnresolvedSubqueryColumnAliases",
}
_SELECT_LISTS = {"Project", "Aggregate"}

# Parsed nodes that run commands, or whose meaning is computed from text
_REFUSED_NODES = {
    "ScriptTransformation": "TRANSFORM",
    "ExpressionWithUnresolvedIdentifier": "IDENTIFIER",
    "PlanWithUnresolvedIdentifier": "IDENTIFIER",
}


class QueryRefused(ValueError):
    """The guard did not let a query through."""


def guard(spark: SparkSession, query: str, views: Iterable[str]) -> None:
    """Raise unless the text is one SELECT over the given views.

    Decided on what Spark's parser makes of the text, before anything is looked up or
    run. Words within literals and names do not matter. Refused are commands, script
    transformations, calls of Java methods and of functions that show storage paths,
    computed identifiers, and every relation but the views, joins and subqueries of them,
    and the query's own WITH clauses (below the top, where a WITH is no SELECT). The text
    has to begin with SELECT, as FROM ... |> SELECT does not.
    """
    plan = _parsed(spark, query)
    if not re.match(r"(\s|\(|--[^\n]*(\n|$)|/\*.*?\*/)*select\b", query, re.IGNORECASE | re.DOTALL):
        raise QueryRefused(ONLY_SELECT)
    while _kind(plan) in _ABOVE_SELECT:
        plan = plan.children().apply(0)
    if _kind(plan) == "ScriptTransformation":
        raise QueryRefused(f"{SQL_ERROR_PREFIX}TRANSFORM is not allowed")
    if _kind(plan) not in _SELECT_LISTS:
        raise QueryRefused(ONLY_SELECT)
    _check(_parsed(spark, query), {name.lower() for name in views})


def _parsed(spark: SparkSession, query: str):
    parser = spark._jsparkSession.sessionState().sqlParser()
    try:
        return parser.parsePlan(query)
    except ParseException:
        starts = [i for i, c in enumerate(query) if c == ";" and query[i + 1 :].strip()]
        if any(_parses(parser, query[:i]) for i in starts):
            raise QueryRefused(ONE_STATEMENT) from None
        if not query.strip():
            raise QueryRefused(ONLY_SELECT) from None
        raise


def _parses(parser, text: str) -> bool:
    try:
        parser.parsePlan(text)
        return True
    except ParseException:
        return False


def _kind(node) -> str:
    return node.getClass().getSimpleName()


def _is_plan(node) -> bool:
    plans = "org.apache.spark.sql.catalyst.plans.logical.LogicalPlan"
    loader = node.getClass().getClassLoader()
    return loader.loadClass(plans).isInstance(node)


def _items(sequence) -> Iterator:
    for i in range(sequence.size()):
        yield sequence.apply(i)


def _check(node, views: set[str]) -> None:
    """Walk a parsed plan with its subqueries and expressions."""
    kind = _kind(node)
    if kind in _REFUSED_NODES:
        raise QueryRefused(f"{SQL_ERROR_PREFIX}{_REFUSED_NODES[kind]} is not allowed")
    if _is_plan(node) and kind not in _PLAN_NODES:
        raise QueryRefused(f"{SQL_ERROR_PREFIX}{node.nodeName()} is not allowed")
    if kind == "UnresolvedWith":
        for relation in _items(node.cteRelations()):
            _check(relation._2(), views)
            views = views | {relation._1().lower()}
        _check(node.child(), views)
        return
    if kind == "UnresolvedRelation":
        parts = list(_items(node.multipartIdentifier()))
        if len(parts) != 1 or parts[0].lower() not in views:
            raise QueryRefused(f"{SQL_ERROR_PREFIX}there is no view {'.'.join(parts)}")
    if kind == "UnresolvedFunction":
        name = list(_items(node.nameParts()))[-1].lower()
        if name in _REFUSED_CALLS:
            raise QueryRefused(f"{SQL_ERROR_PREFIX}{name} is not allowed")
    if kind == "UnresolvedAttribute":
        if _FILE_COLUMN in [part.lower() for part in _items(node.nameParts())][:2]:
            raise QueryRefused(f"{SQL_ERROR_PREFIX}{_FILE_COLUMN} is not allowed")
    for child in _items(node.children()):
        _check(child, views)
    if _is_plan(node):
        for inner in [*_items(node.innerChildren()), *_items(node.expressions())]:
            _check(inner, views)


def bound_cost(rows: DataFrame, views: Iterable[str]) -> None:
    """Raise if a query's plan has no bound that Spark keeps by itself.

    Decided on the analysed plan, where a function has one name, and on the planned
    joins, before anything runs. Refused are aggregates that gather a group into one
    value, generators (a row may become any number of rows), and joins without an
    equality, which compare all pairs. What the views themselves are made of is not
    looked at. Rows that merely pass through tasks are Spark's to spill.
    """
    execution = rows._jdf.queryExecution()
    _check_values(execution.analyzed(), {name.lower() for name in views})
    joins = [n for n in _descendants(execution.sparkPlan()) if _kind(n) in _ALL_PAIRS]
    # plans of their own, which are not yet planned
    for subquery in _items(execution.optimizedPlan().subqueriesAll()):
        joins += [n for n in _descendants(subquery) if _kind(n) == "Join" and not _has_equality(n)]
    if joins:
        raise QueryRefused(f"{SQL_ERROR_PREFIX}a join needs an equality")


def _descendants(node) -> Iterator:
    yield node
    for child in _items(node.children()):
        yield from _descendants(child)


def _has_equality(join) -> bool:
    """Whether a value of the left side has to equal one of the right side."""
    if join.condition().isEmpty():
        return False
    sides = join.left().outputSet(), join.right().outputSet()
    waiting = [join.condition().get()]
    while waiting:
        test = waiting.pop()
        if _kind(test) == "And":
            waiting.extend(_items(test.children()))
        elif _kind(test) in ("EqualTo", "EqualNullSafe"):
            a, b = (e.references() for e in _items(test.children()))
            for left, right in ((a, b), (b, a)):
                if not left.isEmpty() and not right.isEmpty() and left.subsetOf(sides[0]) and right.subsetOf(sides[1]):
                    return True
    return False


def _check_values(node, views: set[str]) -> None:
    kind = _kind(node)
    if kind == "SubqueryAlias" and node.alias().lower() in views and _kind(node.child()) == "View":
        return
    if kind in _GATHERING:
        raise QueryRefused(f"{SQL_ERROR_PREFIX}{node.prettyName()} gathers a group into one value")
    if kind == "Generate" or (not _is_plan(node) and _is_generator(node)):
        raise QueryRefused(f"{SQL_ERROR_PREFIX}a row may not be turned into several")
    for child in _items(node.children()):
        _check_values(child, views)
    if _is_plan(node):
        for inner in [*_items(node.innerChildren()), *_items(node.expressions())]:
            _check_values(inner, views)
    elif _kind(node) in _SUBQUERIES:
        _check_values(node.plan(), views)


_SUBQUERIES = {"ScalarSubquery", "Exists", "ListQuery", "LateralSubquery"}


def _is_generator(node) -> bool:
    generator = "org.apache.spark.sql.catalyst.expressions.Generator"
    return node.getClass().getClassLoader().loadClass(generator).isInstance(node)


class SqlGate:
    """Runs guarded queries in a session of its own.

    Queries may name only the given views; other tables, global views and files are
    refused. The session takes over the caller's SQL settings as they are now.

    At most ``row_cap`` rows come back, all of them with None. ``is_cut`` tells whether
    rows of a query were left out, and ``answer`` logs it.

    A query whose cost or values nothing bounds is refused (``bound_cost``), unless
    ``bounded`` is False. A record of more than ``value_limit`` bytes fails the query in
    the task that makes it, before it reaches the driver.
    """

    def __init__(
        self,
        views: Mapping[str, DataFrame] | DataFrame,
        row_cap: int | None = ROW_CAP,
        bounded: bool = True,
        value_limit: int = VALUE_LIMIT_BYTES,
    ):
        if isinstance(views, DataFrame):
            views = {DEFAULT_VIEW: views}
        parent = next(iter(views.values())).sparkSession
        self.row_cap, self.bounded, self.value_limit = row_cap, bounded, value_limit
        self._views = list(views)
        self._session = parent.newSession()
        for key, value in parent.conf.getAll.items():
            if key.startswith("spark.sql.") and parent.conf.isModifiable(key):
                self._session.conf.set(key, value)
        self._session.conf.set("spark.sql.runSQLOnFiles", "false")
        for name, df in views.items():
            self._hand_over(parent, name, df)

    def query(self, query: str) -> DataFrame:
        """The capped result. Without an ORDER BY, any rows may be those that come back."""
        rows = self._rows(query)
        return rows if self.row_cap is None else rows.limit(self.row_cap)

    def is_cut(self, query: str) -> bool:
        """Whether the query has more rows than the cap lets through."""
        if self.row_cap is None:
            return False
        return self._rows(query).limit(self.row_cap + 1).count() > self.row_cap

    def records(self, query: str) -> DataFrame:
        """The capped result as one JSON object per row."""
        return self._within_limit(json_records(self.query(query)))

    def answer(self, query: str) -> str:
        """A JSON array of records, or a message; never raises. Collects the capped rows."""
        try:
            records = self._within_limit(json_records(self._rows(query)))
            if self.row_cap is not None:
                records = records.limit(self.row_cap + 1)
            rows = [row["record"] for row in records.collect()]
        except QueryRefused as refusal:
            return str(refusal)
        except Exception as error:  # every failure of the query is its answer
            return f"{SQL_ERROR_PREFIX}{error}"
        if self.row_cap is not None and len(rows) > self.row_cap:
            logging.getLogger(__name__).warning("only %d rows are returned", self.row_cap)
            rows = rows[: self.row_cap]
        return f"[{','.join(rows)}]" if rows else NO_ROWS

    def _rows(self, query: str) -> DataFrame:
        guard(self._session, query, self._views)
        rows = self._session.sql(query)
        if self.bounded:
            bound_cost(rows, self._views)
        return rows

    def _within_limit(self, records: DataFrame) -> DataFrame:
        too_long = F.raise_error(F.lit(f"a record has more than {self.value_limit} bytes"))
        fits = F.octet_length("record") <= self.value_limit
        return records.select(F.when(fits, F.col("record")).otherwise(too_long.cast("string")).alias("record"))

    def _hand_over(self, parent, name: str, df: DataFrame) -> None:
        # temp views belong to one session; a global one carries the plan across
        carrier = f"handover_{uuid.uuid4().hex}"
        df.createGlobalTempView(carrier)
        try:
            self._session.table(f"global_temp.{carrier}").createOrReplaceTempView(name)
        finally:
            parent.catalog.dropGlobalTempView(carrier)


def json_records(df: DataFrame) -> DataFrame:
    """One JSON object per row: nulls kept, dates as epoch milliseconds, 10 decimals."""
    if len(set(df.columns)) != len(df.columns):
        raise ValueError("records need distinct column names")
    fields = [_json_value(field).alias(field.name) for field in df.schema.fields]
    record = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    return df.select(record.alias("record"))


def _json_value(field: T.StructField) -> Column:
    column = F.col("`{}`".format(field.name.replace("`", "``")))
    if isinstance(field.dataType, T.DateType):
        return F.unix_date(column).cast("bigint") * 86_400_000
    if isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
        # the wall-clock time in the session's zone, counted as if it were UTC
        instant = column.cast("timestamp")
        return F.unix_millis(F.from_utc_timestamp(instant, F.current_timezone()))
    if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
        finite = ~F.isnan(column) & (F.abs(column) < F.lit(float("inf")))
        return F.when(finite, F.round(column, 10))
    if isinstance(field.dataType, T.DecimalType):
        return F.round(column.cast("double"), 10)
    return column
