"""Ad-hoc SQL, read only: what may run is decided on Spark's own plans, by what they are made of.

A statement is looked at twice, each time with allow-lists, so that what is not known is refused. The parsed plan must
hold nothing that resolving it would already evaluate or look up elsewhere: no identifiers made of expressions, functions
by their plain names only, relations among the views. The analysed plan, in which every name has become the class that
runs, must hold known classes of nodes and expressions down to the views, whose own plans are their owner's affair.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_ROWS = 500
#: Functions that only compute from their arguments.
FUNCTIONS = set("""abs any_value array array_contains array_join array_size array_sort avg between bround bool_and bool_or case ceil ceiling coalesce concat concat_ws contains count count_if
date_add date_format date_sub date_trunc datediff day dayofmonth dayofweek dense_rank element_at endswith exists exp extract filter first first_value floor format_number greatest hour if ifnull initcap instr isnotnull isnull
last last_value lag last_day lead least left length ln log10 lower lpad ltrim make_date max max_by md5 mean median min min_by minute mod month months_between named_struct ntile nullif nvl nvl2
percent_rank percentile percentile_approx pmod power quarter rank regexp_extract regexp_like regexp_replace replace reverse right round row_number rpad rtrim second sha2 sign size split split_part sqrt startswith
stddev stddev_pop stddev_samp struct substr substring sum to_date to_timestamp transform trim trunc try_divide upper var_pop variance var_samp weekofyear when year zeroifnull""".split())
#: Nodes of either plan that read. A view ends the walk; a bare relation of files or a catalog is none of these.
NODES = set("""Project Filter Aggregate Sort GlobalLimit LocalLimit Offset Join SubqueryAlias Distinct Union Intersect Except Window OneRowRelation LocalRelation Expand
WithCTE CTERelationDef CTERelationRef View Subquery UnresolvedHaving UnresolvedWith UnresolvedSubqueryColumnAliases UnresolvedRelation UnresolvedInlineTable WithWindowDefinition ResolvedInlineTable""".split())
#: Expressions that syntax makes without a function's name, resolved and not.
EXPRESSIONS = set("""Alias AttributeReference OuterReference Literal Cast And Or Not EqualTo EqualNullSafe LessThan LessThanOrEqual GreaterThan GreaterThanOrEqual In InSet InSubquery ListQuery ScalarSubquery Exists
IsNull IsNotNull IsTrue IsFalse Between Like ILike RLike CaseWhen If Add Subtract Multiply Divide IntegralDivide Remainder UnaryMinus UnaryPositive Concat SortOrder AggregateExpression WindowExpression
WindowSpecDefinition SpecifiedWindowFrame UnspecifiedFrame$ CurrentRow$ UnboundedPreceding$ UnboundedFollowing$ LambdaFunction NamedLambdaVariable GetStructField GetArrayItem GetMapValue ElementAt CreateArray
CreateNamedStruct DateAdd DateSub SubtractDates TimestampAdd TimestampDiff Extract NamePlaceholder$ GroupingSets Cube Rollup Grouping GroupingID
UnresolvedAttribute UnresolvedStar UnresolvedAlias UnresolvedFunction UnresolvedExtractValue UnresolvedWindowExpression UnresolvedNamedLambdaVariable WindowSpecReference UnresolvedOrdinal
StringLPad StringRPad RoundCeil RoundFloor SecondWithFraction PredicateSubquery LateralColumnAliasReference MultiAlias TempResolvedColumn""".split())


class Refused(ValueError):
    """The text is no single reading statement over allowed tables."""


def each(seq) -> Iterator:
    return (seq.apply(i) for i in range(seq.size()))


def classes(spark: SparkSession, names: set[str]) -> set[str]:
    """The classes that Spark's registry of built-in functions builds for ``names``."""
    jvm = spark._jvm
    registry = jvm.org.apache.spark.sql.catalyst.analysis.FunctionRegistry.builtin()
    found = set()
    for name in names:
        info = registry.lookupFunction(jvm.org.apache.spark.sql.catalyst.FunctionIdentifier(name))
        if info.isDefined():
            found.add(info.get().getClassName().rpartition(".")[2].removesuffix("ExpressionBuilder"))
    return found


def kind_of(x) -> str:
    return x.getClass().getName().rpartition(".")[2]


def walk(spark: SparkSession, plan, node: Callable, expression: Callable) -> None:
    """Calls ``node`` and ``expression`` for every part of a plan, its subqueries and common tables; ``node`` returns
    False where the walk ends. An expression that Spark writes as another is judged by its own name and parameters."""
    stand_ins = spark._jvm.java.lang.Class.forName("org.apache.spark.sql.catalyst.expressions.InheritAnalysisRules")

    def inside(e) -> None:
        expression(e)
        for x in each(e.parameters() if stand_ins.isInstance(e) else e.children()):
            inside(x)

    def down(p) -> None:
        if node(p) is False:
            return
        for e in each(p.expressions()):
            inside(e)
        for part in (*each(p.children()), *each(p.subqueries()), *each(p.innerChildren())):
            down(part)

    down(plan)


def relations(plan, tables: set[str]) -> set[str]:
    """The tables of a parsed plan that are no common tables of the part that names them."""
    names: set[str] = set()

    def down(p, scope: frozenset) -> None:
        kind = kind_of(p)
        if kind == "UnresolvedRelation" and (name := p.name().lower()) not in scope:
            names.add(name)
        if kind == "UnresolvedWith":
            for entry in each(p.cteRelations()):
                down(entry._2(), scope)
                scope = scope | {entry._1().lower()}
        else:
            for part in each(p.innerChildren()):
                down(part, scope)
        for part in (*each(p.children()), *each(p.subqueries())):
            down(part, scope)

    down(plan, frozenset())
    if extra := names - tables:
        raise Refused(f"unknown tables {sorted(extra)}")
    return names


def parsed(spark: SparkSession, text: str, tables: set[str]) -> str:
    """The statement without fences, if resolving it is safe: one that reads at least one of the tables."""
    text = re.sub(r"^```(?:sql)?\s*|\s*```$", "", text.strip()).rstrip(";").strip()
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    except Exception as error:
        raise Refused("not one statement of SQL") from error
    known = EXPRESSIONS | classes(spark, FUNCTIONS)

    def node(p) -> None:
        if kind_of(p) not in NODES:
            raise Refused(f"{kind_of(p)} is not allowed")

    def expression(e) -> None:
        kind = kind_of(e)
        if kind == "UnresolvedFunction":
            if (name := e.nameParts().mkString(".").lower()) not in FUNCTIONS:
                raise Refused(f"function {name} is not allowed")
        elif kind not in known:
            raise Refused(f"{kind} is not allowed")

    walk(spark, plan, node, expression)
    if not relations(plan, {t.lower() for t in tables}):
        raise Refused("the statement reads no table")
    return text


def analysed(spark: SparkSession, frame: DataFrame, tables: set[str]) -> None:
    """Refuses a frame whose analysed plan holds anything unknown above the views ``tables``."""
    known = {k for k in EXPRESSIONS if not k.startswith("Unresolved")} | classes(spark, FUNCTIONS)
    allowed = {t.lower() for t in tables}

    def node(p) -> bool:
        kind = kind_of(p)
        if kind not in NODES or kind.startswith("Unresolved"):
            raise Refused(f"{kind} is not allowed")
        if kind == "View" and p.desc().identifier().table().lower() not in allowed:
            raise Refused(f"view {p.desc().identifier().table()} is not allowed")
        return kind != "View"

    def expression(e) -> None:
        if kind_of(e) not in known:
            raise Refused(f"{kind_of(e)} is not allowed")

    walk(spark, frame._jdf.queryExecution().analyzed(), node, expression)


def scoped(frames: dict[str, DataFrame], tenant: str, column: str = "tenant_id") -> dict[str, DataFrame]:
    """Each frame with one tenant's rows only and without the column that says so: a statement that names a tenant
    finds no such column. A frame without the column cannot be scoped and is refused."""
    for name, frame in frames.items():
        if column not in frame.columns:
            raise Refused(f"{name} has no {column}")
    return {name: frame.filter(F.col(column) == tenant).drop(column) for name, frame in frames.items()}


def run(spark: SparkSession, text: str, views: dict[str, DataFrame]) -> DataFrame:
    """At most MOST_ROWS rows of a guarded statement over views that hold one tenant's rows only: scoping by what the
    names mean is stronger than rewriting the text."""
    statement = parsed(spark, text, set(views))
    for name, frame in views.items():
        frame.createOrReplaceTempView(name)
    try:
        frame = spark.sql(statement)
    except PySparkException as error:
        raise Refused("the statement cannot be resolved") from error
    analysed(spark, frame, set(views))
    return frame.limit(MOST_ROWS)
