"""The typed query specification that a question becomes, before any SQL or DataFrame."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Literal

Intent = Literal["count", "exists", "sum", "avg", "min", "max", "top", "list"]
INTENTS: tuple[Intent, ...] = ("count", "exists", "sum", "avg", "min", "max", "top", "list")
AGGREGATES = ("count", "exists", "sum", "avg", "min", "max")


class PlanError(ValueError):
    """A question that cannot be planned; the text says why."""


@dataclass(frozen=True)
class Ref:
    table: str
    column: str

    def __str__(self) -> str:
        return f"{self.table}.{self.column}"


@dataclass(frozen=True)
class Predicate:
    """``op``: = <> < <= > >= between contains is_null not_null. ``contains`` ignores case."""

    ref: Ref
    op: str
    value: object = None
    upper: object = None


@dataclass(frozen=True)
class Join:
    left: Ref
    right: Ref


@dataclass(frozen=True)
class Projection:
    ref: Ref
    alias: str


@dataclass(frozen=True)
class QuerySpec:
    intent: Intent
    primary: str
    joins: tuple[Join, ...] = ()
    projections: tuple[Projection, ...] = ()
    aggregate: Ref | None = None
    predicates: tuple[Predicate, ...] = ()
    order: tuple[tuple[Ref, bool], ...] = ()  # (column, descending)
    limit: int | None = None
    star: bool = False

    @property
    def tables(self) -> tuple[str, ...]:
        return (self.primary, *(j.right.table for j in self.joins))


@dataclass
class Plan:
    spec: QuerySpec | None
    intent: str
    confidence: float
    explanation: str
    ignored: list[str] = field(default_factory=list)
    used_columns: list[str] = field(default_factory=list)

    @property
    def tables_used(self) -> list[str]:
        return sorted(self.spec.tables) if self.spec else []
