"""A specification as SQL text of a dialect: for display, and for other engines. Spark runs the DataFrame form."""

from __future__ import annotations

from datetime import date, datetime

from askframe.plans.spec import Predicate, QuerySpec, Ref

DIALECTS = ("spark", "duckdb", "postgres", "mysql")


def escape_like(text: str) -> str:
    """Wildcards and the escape character itself, to be taken literally."""
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def quote(name: str, dialect: str) -> str:
    mark = "`" if dialect in ("spark", "mysql") else '"'
    return mark + name.replace(mark, mark * 2) + mark


def text_literal(text: str, dialect: str) -> str:
    if dialect in ("spark", "mysql"):
        return "'" + text.replace("\\", "\\\\").replace("'", "\\'" if dialect == "spark" else "''") + "'"
    return "'" + text.replace("'", "''") + "'"


def literal(value: object, dialect: str) -> str:
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, int | float):
        return repr(value)
    if isinstance(value, datetime):
        return f"CAST('{value.isoformat(sep=' ')}' AS TIMESTAMP)"
    if isinstance(value, date):
        return f"CAST('{value.isoformat()}' AS DATE)"
    return text_literal(str(value), dialect)


def _predicate(p: Predicate, dialect: str) -> str:
    c = _ref(p.ref, dialect)
    if p.op == "is_null":
        return f"{c} IS NULL"
    if p.op == "not_null":
        return f"{c} IS NOT NULL"
    if p.op == "between":
        return f"{c} BETWEEN {literal(p.value, dialect)} AND {literal(p.upper, dialect)}"
    if p.op == "contains":
        pattern = text_literal(f"%{escape_like(str(p.value))}%", dialect)
        word = "LIKE" if dialect == "mysql" else "ILIKE"
        return f"{c} {word} {pattern}" + (" ESCAPE '\\'" if dialect in ("duckdb", "postgres") else "")
    return f"{c} {p.op} {literal(p.value, dialect)}"


def _ref(r: Ref, dialect: str) -> str:
    return f"{quote(r.table, dialect)}.{quote(r.column, dialect)}"


def render(spec: QuerySpec, dialect: str = "spark") -> str:
    if dialect not in DIALECTS:
        raise ValueError(f"dialect must be one of {DIALECTS}")
    q = lambda n: quote(n, dialect)
    if spec.intent == "count":
        what = f"COUNT(*) AS {q('count')}"
    elif spec.intent == "exists":
        what = f"COUNT(*) > 0 AS {q('exists')}"
    elif spec.aggregate is not None:
        what = f"{spec.intent.upper()}({_ref(spec.aggregate, dialect)}) AS {q(spec.intent)}"
    elif spec.star:
        what = "*"
    else:
        what = ", ".join(_ref(p.ref, dialect) + (f" AS {q(p.alias)}" if p.alias != p.ref.column else "") for p in spec.projections)
    sql = f"SELECT {what} FROM {q(spec.primary)}"
    for j in spec.joins:
        sql += f" INNER JOIN {q(j.right.table)} ON {_ref(j.left, dialect)} = {_ref(j.right, dialect)}"
    if spec.predicates:
        sql += " WHERE " + " AND ".join(_predicate(p, dialect) for p in spec.predicates)
    if spec.order:
        last = " NULLS LAST" if dialect != "mysql" else ""
        sql += " ORDER BY " + ", ".join(f"{_ref(r, dialect)} {'DESC' if down else 'ASC'}{last}" for r, down in spec.order)
    if spec.limit is not None:
        sql += f" LIMIT {spec.limit}"
    return sql
