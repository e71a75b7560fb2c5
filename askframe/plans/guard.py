"""The guard on foreign SQL: one read-only query over allowed tables, checked on Catalyst's own parse tree.

Everything is an allowlist: a kind of plan that is not known here is refused, and so is a function that is not a built-in one of the groups
below. The analysed plan is checked again (:func:`check_analyzed`), so what one walk missed the other sees.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.errors import ParseException
from pyspark.sql import DataFrame, SparkSession

MAX_ROWS = 500
#: Plan nodes that only read.
ALLOWED = frozenset(
    """
    Project Filter Aggregate Join Sort GlobalLimit LocalLimit Limit Offset Union Distinct Intersect Except SubqueryAlias UnresolvedWith UnresolvedRelation
    UnresolvedHaving UnresolvedSubqueryColumnAliases WithWindowDefinition Window OneRowRelation UnresolvedInlineTable LocalRelation Expand Generate Pivot UnresolvedPivot Tail
    LateralJoin Deduplicate View GlobalLimitAndOffset UnresolvedOrdinal UnresolvedHint ResolvedInlineTable Unpivot
    """.split()
)
#: Groups of Spark's built-in functions that only compute on values.
GROUPS = frozenset(
    """
    agg_funcs array_funcs bitwise_funcs collection_funcs conditional_funcs conversion_funcs csv_funcs datetime_funcs generator_funcs hash_funcs json_funcs lambda_funcs
    map_funcs math_funcs predicate_funcs string_funcs struct_funcs url_funcs window_funcs
    """.split()
)
#: Functions that are refused though their group is allowed: they fail on purpose, or make values of any size.
DENIED = frozenset("raise_error assert_true sequence".split())
#: Functions whose argument of this place must be a whole number up to MOST_CHARS: it says how long the value gets.
SIZED, MOST_CHARS = {"repeat": 1, "space": 0, "lpad": 1, "rpad": 1, "array_repeat": 1}, 10_000
#: Expressions of an analysed plan that reach outside the tables.
OUTSIDE = frozenset("CallMethodViaReflection TryReflect InputFileName InputFileBlockStart InputFileBlockLength RaiseError ScalaUDF PythonUDF CurrentUser SparkVersion".split())


class GuardError(ValueError):
    """SQL that is refused; the text says why."""

#: Aggregates of one value.
AGGREGATES = frozenset({"count", "sum", "avg", "min", "max"})


@dataclass(frozen=True)
class Checked:
    sql: str
    tables: tuple[str, ...]
    limit: int | None  # rows that the result may have; None for a single row


def _items(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _each(iterable) -> list:
    out, it = [], iterable.iterator()
    while it.hasNext():
        out.append(it.next())
    return out


class _Walk:
    """One statement's check."""

    def __init__(self, spark: SparkSession, names: dict[str, str]):
        jvm = spark._jvm
        self.names, self.used = names, set()
        self.registry = jvm.org.apache.spark.sql.catalyst.analysis.FunctionRegistry.builtin()
        self.identifier = jvm.org.apache.spark.sql.catalyst.FunctionIdentifier

    def group(self, name: str) -> str | None:
        info = self.registry.lookupFunction(self.identifier(name))
        return info.get().getGroup() if info.isDefined() else None

    def function(self, name: str, arguments: list) -> None:
        if name in DENIED or self.group(name) not in GROUPS:
            raise GuardError(f"function {name} is not allowed")
        if name in SIZED:
            size = arguments[SIZED[name]] if len(arguments) > SIZED[name] else None
            if size is None or size.getClass().getSimpleName() != "Literal" or not isinstance(size.value(), int) or size.value() > MOST_CHARS:
                raise GuardError(f"function {name} needs a size of at most {MOST_CHARS}")


def check(spark: SparkSession, sql: str, allowed: list[str], max_rows: int = MAX_ROWS) -> Checked:
    """Parse and check; raises GuardError. Names of tables are compared without case; CTEs may be used below their WITH."""
    text = sql.strip().rstrip(";").strip()
    if not text:
        raise GuardError("empty SQL")
    try:
        root = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    except ParseException as e:
        raise GuardError(f"not one valid statement: {str(e).strip().splitlines()[0][:200]}") from e
    except Exception as e:  # the parser's errors come as Java exceptions too
        raise GuardError(f"not one valid statement: {str(e).strip().splitlines()[0][:200]}") from e
    walk = _Walk(spark, {t.lower(): t for t in allowed})
    _walk(root, walk, frozenset())
    return Checked(text, tuple(sorted(walk.used)), None if _single_row(root) else max_rows)


def check_analyzed(df: DataFrame) -> DataFrame:
    """``df``, if its analysed plan reads views only (those of the allowed tables) and holds no expression that reaches outside."""
    _analyzed(df._jdf.queryExecution().analyzed())
    return df


def _analyzed(node) -> None:
    kind = node.getClass().getSimpleName()
    if kind == "View":  # made by the engine, not by the statement
        return
    for e in _items(node.expressions()):
        _analyzed_expression(e)
    below = _items(node.children())
    if not below and kind not in ("OneRowRelation", "LocalRelation", "CTERelationRef", "ResolvedInlineTable"):
        raise GuardError(f"{kind} is not allowed: only known tables")
    for c in below:
        _analyzed(c)


def _analyzed_expression(e) -> None:
    kind = e.getClass().getSimpleName()
    if kind in OUTSIDE:
        raise GuardError(f"{kind} is not allowed")
    if kind in ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery"):
        _analyzed(e.plan())
    for c in _items(e.children()):
        _analyzed_expression(c)


def _single_row(root) -> bool:
    """Whether a statement is a global aggregate: only aggregates of one value are selected, and nothing groups them."""
    if root.getClass().getSimpleName() != "Project":
        return False
    found = [_aggregates(e) for e in _items(root.expressions())]
    return None not in found and any(found)


def _aggregates(e) -> bool | None:
    """True where an expression has an aggregate, False for constants, None where it depends on single rows."""
    kind = e.getClass().getSimpleName()
    if kind == "UnresolvedFunction" and _items(e.nameParts())[-1].lower() in AGGREGATES:
        return True
    if kind in ("UnresolvedAttribute", "UnresolvedStar", "WindowExpression", "UnresolvedWindowExpression", "UnresolvedGenerator"):
        return None
    found = [_aggregates(c) for c in _items(e.children())]
    return None if None in found else any(found)


def _walk(node, walk: _Walk, ctes: frozenset[str]) -> None:
    kind = node.getClass().getSimpleName()
    if kind not in ALLOWED:
        raise GuardError(f"{kind} is not allowed: only queries that read")
    if kind == "UnresolvedWith":
        for pair in _items(node.cteRelations()):
            _walk(pair._2(), walk, ctes)
            ctes = ctes | {pair._1().lower()}
    elif kind == "WithWindowDefinition":  # a map, which neither expressions() nor children() shows
        for pair in _each(node.windowDefinitions()):
            _expression(pair._2(), walk, ctes)
    elif kind == "UnresolvedRelation":
        path = _items(node.multipartIdentifier())
        if len(path) != 1:
            raise GuardError(f"table {'.'.join(path)} is not allowed")
        if path[0].lower() in ctes:
            return
        if path[0].lower() not in walk.names:
            raise GuardError(f"table {path[0]} is not known")
        walk.used.add(walk.names[path[0].lower()])
    for e in _items(node.expressions()):
        _expression(e, walk, ctes)
    for c in _items(node.children()):
        _walk(c, walk, ctes)


def _expression(e, walk: _Walk, ctes: frozenset[str]) -> None:
    kind = e.getClass().getSimpleName()
    if kind == "UnresolvedFunction":
        name = ".".join(_items(e.nameParts())).lower()
        walk.function(name, _items(e.arguments()))
    elif kind == "UnresolvedGenerator":
        walk.function(e.name().unquotedString().lower(), _items(e.children()))
    elif kind in ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery", "FunctionTableSubqueryArgumentExpression"):
        _walk(e.plan(), walk, ctes)
    elif re.search("Subquery", kind) and kind != "InSubquery":
        raise GuardError(f"{kind} is not allowed")
    for c in _items(e.children()):
        _expression(c, walk, ctes)
