"""Read-only ad-hoc SQL over listed views. Spark's own parser gives the tree; it is walked before anything is analyzed, and may hold known nodes and
functions alone. What the analyzed plan then reads must lie below the views."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: The functions that a query may call. All others are rejected, whatever Spark may add.
FUNCTIONS = set("""
abs any_value approx_count_distinct array array_contains array_distinct array_join array_max array_min array_size array_sort avg between bool_and bool_or cardinality ceil
ceiling char_length coalesce collect_list collect_set concat concat_ws contains corr count count_if cume_dist date date_add date_diff date_format date_sub date_trunc datediff
day dayofmonth dayofweek dayofyear dense_rank element_at endswith every exp explode filter first first_value floor forall greatest hour if ifnull initcap instr isnan isnotnull
isnull lag last last_value lcase lead least left len length levenshtein like ln locate log log10 lower lpad ltrim max max_by md5 mean median min min_by minute mod mode month
months_between named_struct ntile nullif nvl nvl2 percent_rank percentile percentile_approx pmod position pow power quarter rank regexp_count regexp_extract regexp_like
regexp_replace regexp_substr repeat replace reverse right round row_number rpad rtrim second sha1 sha2 sign size sort_array split split_part sqrt startswith std stddev
stddev_pop stddev_samp string struct substr substring sum timestampdiff to_date to_timestamp transform trim trunc try_cast try_divide ucase unix_timestamp upper var_pop
var_samp variance weekday weekofyear when year zip_with
""".split())
#: The nodes of parsed plans and expressions, and of analyzed plans, that a query may consist of. An unknown node is rejected.
PLANS = set("""
Aggregate CTERelationDef CTERelationRef Distinct Except Expand Filter Generate GlobalLimit Intersect Join LateralJoin LocalLimit LocalRelation Offset OneRowRelation Project Sort
SubqueryAlias Tail Union UnresolvedHaving UnresolvedInlineTable UnresolvedRelation UnresolvedSubqueryColumnAliases UnresolvedWith Window WithCTE WithWindowDefinition
""".split())
EXPRESSIONS = set("""
Add Alias And AttributeReference Between CaseWhen Cast Concat CreateArray CreateNamedStruct CreateStruct CurrentRow$ Divide EqualNullSafe EqualTo Exists ExpressionWithRandomSeed
FunctionTableSubqueryArgumentExpression GreaterThan GreaterThanOrEqual ILike In InSubquery IntegralDivide IsNotNull IsNull LambdaFunction LateralSubquery LessThan LessThanOrEqual
Like LikeAll LikeAny ListQuery Literal MultiAlias Multiply Not NotLikeAll NotLikeAny Or OuterReference Rank RLike Remainder ScalarSubquery SortOrder SpecifiedWindowFrame
StringInstr StringLocate StringReplace StringTrim StringTrimLeft StringTrimRight Substring Subtract UnaryMinus UnaryPositive UnboundedFollowing$ UnboundedPreceding$ UnresolvedAlias
UnresolvedAttribute UnresolvedExtractValue UnresolvedFunction UnresolvedNamedLambdaVariable UnresolvedOrdinal UnresolvedStar UnresolvedSubqueryColumnAliases
UnresolvedWindowExpression UnspecifiedFrame$ WindowExpression WindowSpecDefinition BaseGroupingSets Cube GroupingSets Rollup
""".split())
#: Leaves that hold no data but the query's own.
EMPTY = {"OneRowRelation", "LocalRelation", "CTERelationRef"}


def _seq(x) -> list:
    return [x.apply(i) for i in range(x.size())]


def _name(node) -> str:
    return node.getClass().getSimpleName()


def _expressions(e) -> Iterator:
    yield e
    for child in _seq(e.children()):
        yield from _expressions(child)


def _classes(x) -> Iterator:
    at = x.getClass()
    while at is not None:
        yield at
        at = at.getSuperclass()


def _walk(node, scope: set[str], views: set[str]) -> None:
    """Hold a plan and all plans below it to the rules. scope: the common table expressions that it can see. The body of one sees those
    around its WITH and those before it in the same WITH, never itself, as in Spark's own resolution."""
    kind = _name(node)
    if kind not in PLANS:
        raise ValueError(f"{kind} is not allowed")
    if kind == "UnresolvedRelation":
        parts = [str(x).lower() for x in _seq(node.multipartIdentifier())]
        if len(parts) != 1 or parts[0] not in views | scope:
            raise ValueError(f"table {'.'.join(parts)} is not allowed; allowed: {', '.join(sorted(views))}")
    if kind == "UnresolvedWith":
        if node.allowRecursion():
            raise ValueError("WITH RECURSIVE is not allowed")
        scope = set(scope)
        for relation in _seq(node.cteRelations()):
            _walk(relation._2(), scope, views)
            scope.add(relation._1().lower())
    for e in _seq(node.expressions()):
        for sub in _expressions(e):
            _hold(sub, scope, views)
    for child in _seq(node.children()):
        _walk(child, scope, views)


def _hold(e, scope: set[str], views: set[str]) -> None:
    kind = _name(e)
    if kind not in EXPRESSIONS:
        raise ValueError(f"{kind} is not allowed")
    if kind == "UnresolvedFunction":
        parts = [str(x).lower() for x in _seq(e.nameParts())]
        if len(parts) != 1 or parts[0] not in FUNCTIONS:
            raise ValueError(f"function {'.'.join(parts)} is not allowed")
    if any(c.getSimpleName() == "PlanExpression" for c in _classes(e)):
        _walk(e.plan(), scope, views)


def check(spark: SparkSession, query: str, views: set[str]) -> None:
    """Raise ValueError unless the query is one select over views and its own common table expressions, of known nodes and functions alone."""
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(query)
    except Exception as e:
        raise ValueError(f"not one readable statement: {str(e).splitlines()[0]}") from None
    _walk(plan, set(), {v.lower() for v in views})


def check_leaves(df: DataFrame, views: set[str]) -> None:
    """Raise ValueError if the analyzed plan of df reads anything but the views: every leaf lies below one of them, or holds the query's own
    values."""
    allowed = {v.lower() for v in views}

    def walk(node) -> None:
        if _name(node) == "View" and node.desc().identifier().table().lower() in allowed and not node.desc().identifier().database().isDefined():
            return
        children = _seq(node.children())
        inner = _seq(node.innerChildren()) if _name(node) == "WithCTE" else []
        if not children and _name(node) not in EMPTY:
            raise ValueError(f"{_name(node)} is not allowed")
        for e in _seq(node.expressions()):
            for sub in _expressions(e):
                if any(c.getSimpleName() == "PlanExpression" for c in _classes(sub)):
                    walk(sub.plan())
        for child in [*children, *inner]:
            walk(child)

    walk(df._jdf.queryExecution().analyzed())


def run(spark: SparkSession, query: str, views: dict[str, DataFrame], limit: int = 200, seconds: float = 60.0) -> tuple[DataFrame, bool]:
    """The first rows of a checked query, and whether there are more. It runs once, for `seconds` at most (then TimeoutError). The views
    have their names in the session for as long as it runs; a temporary view of the session with such a name is lost."""
    check(spark, query, set(views))
    group, late = f"guarded-{uuid.uuid4().hex}", threading.Event()

    def stop() -> None:
        late.set()
        spark.sparkContext.cancelJobGroup(group)

    timer = threading.Timer(seconds, stop)
    try:
        for name, df in views.items():
            df.createOrReplaceTempView(name)
        try:
            out = spark.sql(query)
        except Exception as e:
            columns = "; ".join(f"{n}({', '.join(d.columns)})" for n, d in views.items())
            raise ValueError(f"{str(e).splitlines()[0]} Available: {columns}") from None
        check_leaves(out, set(views))
        spark.sparkContext.setJobGroup(group, "guarded SQL", interruptOnCancel=True)
        timer.start()
        try:
            rows = out.limit(limit + 1).collect()  # limit + 1 rows at most
        except Exception:
            if late.is_set():
                raise TimeoutError(f"the query took more than {seconds:g} seconds") from None
            raise
        return spark.createDataFrame(rows[:limit], out.schema), len(rows) > limit
    finally:
        timer.cancel()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for name in views:
            spark.catalog.dropTempView(name)
