"""Syntax tree of a query."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class Literal:
    value: Any


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Prop:
    base: Any
    key: str


@dataclass(frozen=True)
class Unary:
    op: str  # - + NOT ISNULL NOTNULL
    arg: Any


@dataclass(frozen=True)
class Binary:
    op: str  # + - * / % ^ = <> < <= > >= AND OR XOR IN CONTAINS STARTS ENDS
    left: Any
    right: Any


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple
    distinct: bool = False


@dataclass(frozen=True)
class CountStar:
    pass


@dataclass(frozen=True)
class CountPattern:
    path: Any


@dataclass(frozen=True)
class ListExpr:
    items: tuple


@dataclass(frozen=True)
class MapExpr:
    items: tuple  # of (key, expression)


@dataclass(frozen=True)
class Index:
    base: Any
    index: Any


@dataclass(frozen=True)
class Slice:
    base: Any
    start: Any
    end: Any


@dataclass(frozen=True)
class Case:
    subject: Any
    branches: tuple  # of (when, then)
    default: Any


@dataclass(frozen=True)
class Comprehension:
    var: str
    source: Any
    where: Any
    body: Any


@dataclass(frozen=True)
class Quantifier:
    kind: str  # ALL ANY NONE SINGLE
    var: str
    source: Any
    where: Any


@dataclass(frozen=True)
class Reduce:
    acc: str
    init: Any
    var: str
    source: Any
    body: Any


@dataclass(frozen=True)
class PatternComprehension:
    path: Any
    where: Any
    body: Any


@dataclass(frozen=True)
class PatternPredicate:
    path: Any


@dataclass(frozen=True)
class HasLabel:
    base: Any
    labels: Any


@dataclass(frozen=True)
class ShortestPath:
    path: Any
    every: bool


@dataclass(frozen=True)
class LabelTerm:
    """Labels of a pattern: alternatives of conjunctions of (name, negated)."""

    any_of: tuple

    def accepts(self, labels) -> bool:
        return any(all((name in labels) != negated for name, negated in conj) for conj in self.any_of)


@dataclass(frozen=True)
class NodePattern:
    var: str | None
    labels: LabelTerm | None
    props: tuple  # of (key, expression)


@dataclass(frozen=True)
class RelPattern:
    var: str | None
    types: tuple
    props: tuple
    direction: str  # OUT IN BOTH
    low: int | None = None  # variable length if not None
    high: int | None = None


@dataclass(frozen=True)
class PathPattern:
    var: str | None
    nodes: tuple
    rels: tuple


@dataclass(frozen=True)
class Item:
    expr: Any
    alias: str | None
    text: str


@dataclass(frozen=True)
class SortKey:
    expr: Any
    descending: bool = False
    nulls_first: bool | None = None


@dataclass(frozen=True)
class Projection:
    items: tuple
    star: bool = False
    distinct: bool = False
    order: tuple = ()
    skip: int | None = None
    limit: int | None = None
    where: Any = None


@dataclass(frozen=True)
class Match:
    paths: tuple
    optional: bool = False
    where: Any = None


@dataclass(frozen=True)
class With:
    projection: Projection


@dataclass(frozen=True)
class Return:
    projection: Projection


@dataclass(frozen=True)
class Unwind:
    expr: Any
    var: str
    where: Any = None


@dataclass(frozen=True)
class LoadCsv:
    source: str
    var: str
    headers: bool
    sep: str = ","
    quote: str = '"'


@dataclass(frozen=True)
class Create:
    paths: tuple


@dataclass(frozen=True)
class Merge:
    path: PathPattern
    where: Any = None
    on_create: tuple = ()
    on_match: tuple = ()


@dataclass(frozen=True)
class SetItem:
    target: Any  # Prop, or Var with labels
    value: Any = None
    labels: tuple = ()


@dataclass(frozen=True)
class SetClause:
    items: tuple


@dataclass(frozen=True)
class Remove:
    items: tuple


@dataclass(frozen=True)
class Delete:
    exprs: tuple
    detach: bool = False


@dataclass(frozen=True)
class Foreach:
    var: str
    source: Any
    where: Any
    body: tuple


@dataclass(frozen=True)
class CallSubquery:
    query: Any
    yields: tuple = ()
    where: Any = None


@dataclass(frozen=True)
class SingleQuery:
    clauses: tuple


@dataclass(frozen=True)
class Query:
    parts: tuple
    all_flags: tuple = ()  # of each separator: whether it is UNION ALL
    text: str = field(default="", compare=False)


WRITES = (Create, Merge, SetClause, Remove, Delete, Foreach)


def walk(node):
    """All syntax nodes below and including ``node``."""
    if isinstance(node, tuple):
        for x in node:
            yield from walk(x)
    elif hasattr(node, "__dataclass_fields__"):
        yield node
        for name in node.__dataclass_fields__:
            yield from walk(getattr(node, name))
