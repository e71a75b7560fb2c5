"""A specification as a DataFrame. Literals travel as literals; filters, pruning and join strategy are Catalyst's."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askframe.plans.render import escape_like
from askframe.plans.spec import Predicate, QuerySpec, Ref


def _column(r: Ref) -> Column:
    return F.col(f"`{r.table}`.`{r.column}`")


def _condition(p: Predicate) -> Column:
    c = _column(p.ref)
    if p.op == "is_null":
        return c.isNull()
    if p.op == "not_null":
        return c.isNotNull()
    if p.op == "between":
        return c.between(F.lit(p.value), F.lit(p.upper))
    if p.op == "contains":
        return c.ilike(f"%{escape_like(str(p.value))}%")
    value = F.lit(p.value)
    return {"=": c == value, "<>": c != value, "<": c < value, "<=": c <= value, ">": c > value, ">=": c >= value}[p.op]


def compile_spec(spec: QuerySpec, table: Callable[[str], DataFrame]) -> DataFrame:
    """``table`` gives the DataFrame of a table's name."""
    df = table(spec.primary).alias(spec.primary)
    for j in spec.joins:
        df = df.join(table(j.right.table).alias(j.right.table), _column(j.left) == _column(j.right), "inner")
    for p in spec.predicates:
        df = df.where(_condition(p))
    if spec.intent == "count":
        df = df.agg(F.count(F.lit(1)).alias("count"))
    elif spec.intent == "exists":
        # one row settles it: the scan stops early instead of counting everything
        df = df.select(F.lit(1).alias("one")).limit(1).agg((F.count(F.lit(1)) > 0).alias("exists"))
    elif spec.aggregate is not None:
        df = df.agg(getattr(F, spec.intent)(_column(spec.aggregate)).alias(spec.intent))
    else:
        if spec.order:
            df = df.orderBy(*[_column(r).desc_nulls_last() if down else _column(r).asc_nulls_last() for r, down in spec.order])
        if not spec.star:
            df = df.select(*[_column(p.ref).alias(p.alias) for p in spec.projections])
    return df if spec.limit is None else df.limit(spec.limit)
