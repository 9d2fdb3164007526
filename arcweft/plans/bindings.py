"""What the variables of a query stand for in a DataFrame."""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.typed import STRING, Expr
from ..graph import space_id

_numbers = count(1)


def fresh(stem: str = "c") -> str:
    """A column name that no other column has."""
    return f"{stem}__{next(_numbers)}"


@dataclass(frozen=True)
class Node:
    """A bound node: its key column, and the columns of its labels and properties as far as they are loaded."""

    key: str
    space: str | None
    label: str | None = None
    labels: str | None = None
    props: dict = field(default_factory=dict)  # name -> (column, type)
    loaded: bool = True

    def id(self) -> Column:
        return space_id(self.space, F.col(self.key))

    def labels_column(self) -> Column:
        if self.label:
            return F.when(F.col(self.key).isNotNull(), F.array(F.lit(self.label)))
        return F.col(self.labels) if self.labels else F.when(F.col(self.key).isNotNull(), F.array().cast("array<string>"))

    def prop(self, name: str) -> Expr:
        if name in self.props:
            c, t = self.props[name]
            return Expr(F.col(c), t)
        if name == "id":
            return Expr(self.id(), STRING)
        if name == "labels":
            return Expr(self.labels_column(), T.ArrayType(STRING))
        if name == "label" and self.label:
            return Expr(F.when(F.col(self.key).isNotNull(), F.lit(self.label)), STRING)
        return Expr(F.lit(None), T.NullType())

    def columns(self) -> list[str]:
        return [self.key, *([self.labels] if self.labels else []), *[c for c, _ in self.props.values()]]

    def struct(self) -> Expr:
        fields = {"id": Expr(self.id(), STRING), "labels": Expr(self.labels_column(), T.ArrayType(STRING))}
        fields |= {n: Expr(F.col(c), t) for n, (c, t) in sorted(self.props.items()) if n not in fields}
        kind = T.StructType([T.StructField(n, e.type) for n, e in fields.items()])
        return Expr(F.when(F.col(self.key).isNotNull(), F.struct(*[e.col.alias(n) for n, e in fields.items()])), kind)


@dataclass(frozen=True)
class Edge:
    """A bound relationship."""

    key: str  # column of its id
    source: str
    target: str
    source_space: str | None
    target_space: str | None
    type: str | None = None
    type_column: str | None = None
    props: dict = field(default_factory=dict)

    def id(self) -> Column:
        return F.col(self.key)

    def source_id(self) -> Column:
        return space_id(self.source_space, F.col(self.source))

    def target_id(self) -> Column:
        return space_id(self.target_space, F.col(self.target))

    def type_of(self) -> Column:
        return F.when(F.col(self.source).isNotNull(), F.lit(self.type)) if self.type else F.col(self.type_column)

    def prop(self, name: str) -> Expr:
        if name in self.props:
            c, t = self.props[name]
            return Expr(F.col(c), t)
        fixed = {"id": self.id, "source": self.source_id, "target": self.target_id, "type": self.type_of}
        if name in fixed:
            return Expr(fixed[name](), STRING)
        return Expr(F.lit(None), T.NullType())

    def columns(self) -> list[str]:
        return [self.key, self.source, self.target, *([self.type_column] if self.type_column else []), *[c for c, _ in self.props.values()]]

    def struct(self) -> Expr:
        fields = {"id": Expr(self.id(), STRING), "source": Expr(self.source_id(), STRING), "target": Expr(self.target_id(), STRING), "type": Expr(self.type_of(), STRING)}
        fields |= {n: Expr(F.col(c), t) for n, (c, t) in sorted(self.props.items()) if n not in fields}
        kind = T.StructType([T.StructField(n, e.type) for n, e in fields.items()])
        return Expr(F.when(F.col(self.source).isNotNull(), F.struct(*[e.col.alias(n) for n, e in fields.items()])), kind)


@dataclass(frozen=True)
class Value:
    """A value in one column."""

    column: str
    type: T.DataType

    def expr(self) -> Expr:
        return Expr(F.col(self.column), self.type)

    def columns(self) -> list[str]:
        return [self.column]


@dataclass(frozen=True)
class Frame:
    """Rows with the variables that they bind; without a DataFrame it is the single empty row.

    ``factors`` are the two frames of which the rows are every combination, where they are known to be that.
    """

    df: DataFrame
    vars: dict
    factors: tuple = ()

    def with_(self, df: DataFrame, **more) -> Frame:
        return Frame(df, {**self.vars, **more})


NODE_FIELDS, EDGE_FIELDS = ("id", "labels"), ("id", "source", "target", "type")


def is_node_type(t) -> bool:
    return isinstance(t, T.StructType) and tuple(t.fieldNames()[:2]) == NODE_FIELDS


def is_edge_type(t) -> bool:
    return isinstance(t, T.StructType) and tuple(t.fieldNames()[:4]) == EDGE_FIELDS


def is_path_type(t) -> bool:
    return isinstance(t, T.StructType) and t.fieldNames() == ["nodes", "relationships"]
