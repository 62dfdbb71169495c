"""Queries that users write: let through by their parsed plan, and run where every relation holds one tenant's rows alone.

The engine's own parser makes the plan; nothing is run or looked up until the plan's nodes, relations and functions are all
known to be harmless. Relations are then views of a session of their own, each with the tenant predicate on its scan.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Nodes that a parsed query may have. Commands, table functions, scripts, hints, streams and time travel are none of them.
NODES = frozenset(
    "Project Filter Aggregate Join Sort GlobalLimit LocalLimit Offset Distinct Union Except Intersect SubqueryAlias UnresolvedWith UnresolvedSubqueryColumnAliases UnresolvedRelation UnresolvedInlineTable "
    "LocalRelation OneRowRelation UnresolvedHaving Generate LateralJoin Pivot Unpivot UnpivotTransformer WithWindowDefinition Sample Tail PipeOperator".split()
)
#: Functions that call code by its name, tell of files or of the machine, or wait and fail at will.
FUNCTIONS = frozenset("reflect java_method try_reflect input_file_name input_file_block_start input_file_block_length raise_error assert_true current_catalog current_database current_schema version spark_partition_id".split())
LONGEST = 64 * 1024


class QueryRefused(ValueError):
    """A query that the gate does not let through, with all the reasons."""

    def __init__(self, reasons: Sequence[str]):
        super().__init__("; ".join(reasons))
        self.reasons = list(reasons)


@dataclass(frozen=True)
class Relation:
    """What a query may read under a name: rows, and the column that tells the tenant (None: rows that belong to all)."""

    rows: DataFrame
    tenant_column: str | None = "tenant_id"

    def of(self, tenant_id: str) -> DataFrame:
        return self.rows if self.tenant_column is None else self.rows.where(F.col(self.tenant_column) == F.lit(tenant_id))


# -- the walk over a parsed plan


def _each(sequence) -> Iterator:
    for i in range(sequence.size()):
        yield sequence.apply(i)


def _name(parts) -> str:
    return ".".join(_each(parts))


def _expressions(expression) -> Iterator:
    yield expression
    for child in _each(expression.children()):
        yield from _expressions(child)


def _reasons(plan, known: frozenset[str], relations: frozenset[str], kind) -> Iterator[str]:
    """What is wrong with a parsed plan. known: names of the WITH clauses around it, relations: names that may be read."""
    name = plan.nodeName()
    if name not in NODES:
        yield f"{name} is not allowed in a query"
        return
    if name == "UnresolvedWith":
        # A clause sees those before it; only a recursive one sees itself.
        recursive = bool(plan.allowRecursion())
        for pair in _each(plan.cteRelations()):
            own = pair._1().lower()
            yield from _reasons(pair._2(), known | {own} if recursive else known, relations, kind)
            known = known | {own}
        yield from _reasons(plan.child(), known, relations, kind)
        return
    if name == "UnresolvedRelation":
        table = _name(plan.multipartIdentifier())
        if plan.isStreaming():
            yield f"{table} can't be read as a stream"
        if table.lower() not in relations and table.lower() not in known:
            yield f"relation {table} is not allowed"
    for expression in _each(plan.expressions()):
        for e in _expressions(expression):
            class_name = e.getClass().getSimpleName()
            if class_name == "UnresolvedFunction":
                function = _name(e.nameParts())
                if "." in function or function.lower() in FUNCTIONS:
                    yield f"function {function} is not allowed"
            elif class_name == "UnresolvedGenerator":
                function = e.name().funcName()
                if function.lower() not in ("explode", "explode_outer", "posexplode", "posexplode_outer", "inline", "inline_outer", "json_tuple", "stack"):
                    yield f"function {function} is not allowed"
            elif kind.isInstance(e):
                yield from _reasons(e.plan(), known, relations, kind)
    for child in _each(plan.children()):
        yield from _reasons(child, known, relations, kind)


def refusals(spark: SparkSession, sql: str, relations: Sequence[str]) -> list[str]:
    """The reasons for which a query is refused; none: it is one query, reads these relations alone, and calls harmless functions."""
    if len(sql.encode()) > LONGEST:
        return [f"a query has at most {LONGEST} bytes"]
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except ParseException as e:
        return [f"the query can't be parsed: {str(e).strip().splitlines()[0]}"]
    kind = spark._jvm.java.lang.Class.forName("org.apache.spark.sql.catalyst.expressions.PlanExpression", True, spark._jvm.java.lang.Thread.currentThread().getContextClassLoader())
    return list(dict.fromkeys(_reasons(plan, frozenset(), frozenset(r.lower() for r in relations), kind)))


def run_gated(spark: SparkSession, sql: str, relations: Mapping[str, Relation], tenant_id: str, args: Mapping[str, Any] | None = None) -> DataFrame:
    """The rows of a query over a tenant's rows of the relations. Parameters are named (:period); :tenant is always there.

    The query runs in a session of its own, whose views are the relations: the predicate stands on each scan, in
    subqueries and WITH clauses too, so no join, union or aggregate sees another tenant's row.
    """
    if not tenant_id:
        raise QueryRefused(["a query runs for a tenant"])
    if found := refusals(spark, sql, list(relations)):
        raise QueryRefused(found)
    own = spark.newSession()
    of_plan = spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows
    for name, relation in relations.items():
        of_plan(own._jsparkSession, relation.of(tenant_id)._jdf.queryExecution().logical()).createOrReplaceTempView(name)
    try:
        return own.sql(sql, args={"tenant": tenant_id, **(args or {})})
    except AnalysisException as e:  # a column that isn't there, a parameter without a value
        raise QueryRefused([str(e).strip().splitlines()[0]]) from None


# -- observations by SQL

#: Columns of observations, with their types.
OBSERVATION = "tenant_id string, source_key string, entity_id string, metric_date date, measure_key string, value double, subject_key string, dimensions array<struct<key:string,value:string,label:string>>"


def contract_violations(schema: StructType, contract: str = OBSERVATION) -> list[str]:
    """Columns that a schema lacks or has in another type; whole numbers and decimals do where a double is asked for."""
    found = {f.name.lower(): f.dataType for f in schema.fields}
    out = []
    for want in StructType.fromDDL(contract).fields:
        have = found.get(want.name.lower())
        if have is None:
            out.append(f"column {want.name} is lacking")
        elif have.simpleString() != want.dataType.simpleString():
            number = have.typeName() in ("byte", "short", "integer", "long", "float", "decimal")
            if not (want.dataType.typeName() == "double" and number):
                out.append(f"column {want.name} is {have.simpleString()}, not {want.dataType.simpleString()}")
    return out


def observations_by_sql(spark: SparkSession, sql: str, relations: Mapping[str, Relation], tenant_id: str, source_key: str, args: Mapping[str, Any] | None = None, contract: str = OBSERVATION) -> DataFrame:
    """Observations of a source that is a query: through the gate, in the contract's columns and types, of this tenant and source."""
    rows = run_gated(spark, sql, relations, tenant_id, args)
    if found := contract_violations(rows.schema, contract):
        raise QueryRefused(found)
    shaped = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(contract).fields])
    shaped = shaped.where((F.col("tenant_id") == tenant_id) & (F.col("source_key") == source_key))
    return DataFrame(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, shaped._jdf.queryExecution().logical()), spark)


# -- queries by parts

_COMPARE = {
    "=": lambda c, v: c == v, "!=": lambda c, v: c != v, "<": lambda c, v: c < v, "<=": lambda c, v: c <= v, ">": lambda c, v: c > v, ">=": lambda c, v: c >= v,
    "in": lambda c, v: c.isin(list(v)), "is null": lambda c, v: c.isNull(), "is not null": lambda c, v: c.isNotNull(),
}


def tenant_rows(
    relation: Relation, tenant_id: str, columns: Sequence[str] = ("*",), filters: Sequence[tuple[str, str, Any]] = (), order: Sequence[str] = (), limit: int | None = None, offset: int | None = None,
) -> DataFrame:
    """A tenant's rows of one relation. Columns, comparisons and orders (`column`, `column desc`) are names from fixed sets, values are literals."""
    if not tenant_id:
        raise QueryRefused(["a query runs for a tenant"])
    own = set(relation.rows.columns)
    wrong: list[str] = []

    def column(name: str) -> Column:
        if name not in own:
            wrong.append(f"no column is called {name!r}")
            return F.lit(None)
        return F.col(f"`{name}`")

    out = relation.of(tenant_id)
    for name, how, value in filters:
        if how not in _COMPARE:
            wrong.append(f"no comparison is called {how!r}")
            continue
        out = out.where(_COMPARE[how](column(name), value))
    orders = []
    for clause in order:
        name, *way = clause.split()
        if len(way) > 1 or (way and way[0].lower() not in ("asc", "desc")):
            wrong.append(f"{clause!r} is no order")
            continue
        orders.append(column(name).desc() if way and way[0].lower() == "desc" else column(name).asc())
    chosen = ["*"] if list(columns) == ["*"] else [column(c) for c in columns]
    for value in (limit, offset):
        if value is not None and (isinstance(value, bool) or not isinstance(value, int) or value < 0):
            wrong.append(f"{value!r} is no number of rows")
    if wrong:
        raise QueryRefused(wrong)
    out = out.orderBy(*orders) if orders else out
    out = out.offset(offset) if offset else out
    out = out.limit(limit) if limit is not None else out
    return out.select(*chosen)
