"""Guarded SQL over the fund-shaped views: reading only, known views and functions only, parameters bound and never spliced in.

The guard walks Catalyst's tree of the parsed statement: children, expressions, common table expressions and subqueries of every node,
at any width and depth. Every node must be of a known kind, and every function called must be a known one. What the tree holds in places that
aren't walked (a named window, a pipe, a transform by a script) has a node kind that isn't known. The analysed tree is walked too: its
sources must be those of the views, and none of its functions may be of the session's own making.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import Tables

#: What a caller may read. Anything else that the analysed plan reads is refused.
VIEWS = ("company", "inv", "recv", "val")
#: What a caller may call.
FUNCTIONS = frozenset(
    "abs aggregate any_value array array_max array_min array_size avg between bround ceil coalesce collect_list collect_set concat concat_ws count count_if date_add date_format date_sub datediff day "
    "dense_rank element_at exists exp extract filter first first_value floor forall greatest if ifnull isnotnull isnull lag last last_day last_value lead least length ln lower ltrim max max_by "
    "median min min_by mod month months_between ntile nullif nvl percent_rank percentile power quarter rank round row_number rtrim size sort_array sqrt stddev stddev_samp substr substring sum to_date "
    "transform trim trunc upper var_samp when year".split()
)
#: Kinds of parsed plan nodes that only read, and all of whose parts are children, inner children or expressions.
PLANS = frozenset(
    "Aggregate Distinct Except Filter GlobalLimit Intersect Join LocalLimit LocalRelation Offset OneRowRelation Project Sort SubqueryAlias Union UnresolvedHaving UnresolvedInlineTable UnresolvedRelation "
    "UnresolvedSubqueryColumnAliases UnresolvedWith".split()
)
#: Kinds of parsed expressions that compute from their children alone; functions by name come as UnresolvedFunction.
EXPRESSIONS = frozenset(
    "Add Alias And AttributeReference Between CaseWhen Cast Concat CreateNamedStruct Cube CurrentRow$ Divide EqualNullSafe EqualTo Exists GreaterThan GreaterThanOrEqual GroupingSets In InSubquery IntegralDivide IsNotNull IsNull "
    "LambdaFunction LessThan LessThanOrEqual Like ListQuery Literal MultiAlias Multiply NamedParameter Not Or Remainder Rollup ScalarSubquery SortOrder SpecifiedWindowFrame Subtract Trim UnaryMinus UnaryPositive UnboundedFollowing$ "
    "UnboundedPreceding$ UnresolvedAlias UnresolvedAttribute UnresolvedExtractValue UnresolvedFunction UnresolvedNamedLambdaVariable UnresolvedOrdinal UnresolvedStar UnspecifiedFrame$ WindowExpression WindowSpecDefinition".split()
)
SUBQUERIES = frozenset({"Exists", "LateralSubquery", "ListQuery", "ScalarSubquery"})
#: Kinds of analysed expressions that run code which isn't Spark's own.
FOREIGN = re.compile(r"UDF|UDAF|UDTF|Reflection|Aggregator|^ApplyFunctionExpression$|^V2Aggregator$|^TryReflect")
STATEMENT = re.compile(r"^\s*(select|with)\b", re.IGNORECASE)


class Refused(ValueError):
    pass


def walk(spark: SparkSession, root) -> Iterator[tuple[str, bool, object]]:
    """Every node of a Catalyst tree, with its kind and whether it is a plan: subqueries and common table expressions too."""
    jvm = spark.sparkContext._jvm
    as_list = jvm.scala.jdk.javaapi.CollectionConverters.asJava
    plan = jvm.java.lang.Class.forName("org.apache.spark.sql.catalyst.plans.logical.LogicalPlan", True, jvm.java.lang.Thread.currentThread().getContextClassLoader())
    expression = jvm.java.lang.Class.forName("org.apache.spark.sql.catalyst.expressions.Expression", True, jvm.java.lang.Thread.currentThread().getContextClassLoader())
    open_ = [root]
    while open_:
        node = open_.pop()
        kind, is_plan = node.getClass().getSimpleName(), plan.isInstance(node)
        yield kind, is_plan, node
        below = [*as_list(node.children()), *as_list(node.innerChildren())]
        if is_plan:
            below.extend(as_list(node.expressions()))
        elif kind in SUBQUERIES:
            below.append(node.plan())
        open_ += [x for x in below if plan.isInstance(x) or expression.isInstance(x)]


def guard(t: Tables, sql: str) -> None:
    """Refuses what isn't one reading statement made of known nodes that calls known functions."""
    if not STATEMENT.match(sql):
        raise Refused("only SELECT or WITH")
    for kind, is_plan, node in walk(t.spark, t.spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)):
        if kind not in (PLANS if is_plan else EXPRESSIONS):
            raise Refused(f"unknown kind of node: {kind}")
        if kind == "UnresolvedFunction":
            names = node.nameParts()
            name = names.apply(names.size() - 1).lower()
            if names.size() != 1 or name not in FUNCTIONS:
                raise Refused(f"unknown function: {names.mkString('.')}")


def sources(spark: SparkSession, df: DataFrame) -> list:
    """The leaves of the analysed plan, subqueries' too; none of its expressions may run foreign code."""
    found = []
    for kind, is_plan, node in walk(spark, df._jdf.queryExecution().analyzed()):
        if is_plan and node.children().isEmpty():
            found.append((kind, node))
        elif not is_plan and FOREIGN.search(kind):
            raise Refused(f"foreign code: {kind}")
    return found


def run(t: Tables, sql: str, args: dict | None = None) -> DataFrame:
    """The rows of a guarded statement.

    Names of tables prove nothing: a common table expression may have any name, in its own scope. So the statement is analysed, and
    each source that its plan reads must be one that the views read.
    """
    guard(t, sql)
    known = []
    for v in VIEWS:
        getattr(t, v).createOrReplaceTempView(v)
        known += [node for _, node in sources(t.spark, t.spark.table(v))]
    out = t.spark.sql(sql, args or {})
    for kind, node in sources(t.spark, out):
        if kind not in ("OneRowRelation", "CTERelationRef", "LocalRelation") and not any(node.sameResult(k) for k in known):
            raise Refused(f"unknown source: {node.simpleString(3)}")
    return out


def show(df: DataFrame, rows: int = 2000) -> tuple[list, bool]:
    """At most so many rows for display, and whether there are more."""
    got = df.limit(rows + 1).collect()
    return got[:rows], len(got) > rows
