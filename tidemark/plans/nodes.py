"""Plain values that describe queries: predicates, expressions, sorts, aggregations."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import StrEnum
from typing import Any


class Kind(StrEnum):
    """The four logical types."""

    STRING = "string"
    NUMBER = "number"
    DATETIME = "datetime"
    BOOLEAN = "boolean"


class Op(StrEnum):
    EQ = "eq"
    NEQ = "neq"
    CONTAINS = "contains"
    STARTS_WITH = "startsWith"
    REGEX = "regex"
    MATCHES = "matches"
    NOT_MATCHES = "notMatches"
    GT = "gt"
    LT = "lt"
    BETWEEN = "between"
    RANGE = "range"


#: The pseudo-column that holds a row's labels, and the value that stands for having none.
TAG_COLUMN = "__tag"
NO_LABEL = "__tag:none"


@dataclass(frozen=True)
class Predicate:
    column: str
    op: Op
    value: Any = None
    value2: Any = None
    case_sensitive: bool = False
    id: str | None = None


@dataclass(frozen=True)
class Group:
    """Predicates and groups under one ``and`` / ``or``. An empty group is true, under ``or`` too."""

    op: str
    items: tuple["Predicate | Group", ...] = ()

    def __post_init__(self):
        if self.op not in ("and", "or"):
            raise ValueError(f"a group is 'and' or 'or', not {self.op!r}")
        object.__setattr__(self, "items", tuple(self.items))


Node = Predicate | Group


def all_of(*items: Node) -> Group:
    return Group("and", items)


def any_of(*items: Node) -> Group:
    return Group("or", items)


def leaves(node: Node | None) -> list[Predicate]:
    """Predicates, depth first."""
    if node is None:
        return []
    return [node] if isinstance(node, Predicate) else [p for n in node.items for p in leaves(n)]


@dataclass(frozen=True)
class Sort:
    column: str
    descending: bool = False


AGGREGATES = ("count", "sum", "avg", "min", "max")


@dataclass(frozen=True)
class Aggregation:
    op: str = "count"
    column: str | None = None
    alias: str | None = None

    def __post_init__(self):
        if self.op not in AGGREGATES:
            raise ValueError(f"unknown aggregate {self.op!r}")

    @property
    def name(self) -> str:
        if self.alias:
            return self.alias
        return "count" if self.op == "count" and not self.column else f"{self.op}({self.column or '*'})"


@dataclass(frozen=True)
class Filter:
    """One line of a filter list as a user edits it, before it becomes a :class:`Predicate`."""

    column: str
    op: Op | str
    value: Any = None
    value2: Any = None
    case_sensitive: bool = False
    enabled: bool = True
    id: str | None = field(default=None, compare=False)
