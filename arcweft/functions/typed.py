"""Typed column expressions: a Spark column with its data type, known while a query is planned."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

STRING, LONG, DOUBLE, BOOL, NULL = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.NullType()


@dataclass(frozen=True)
class Expr:
    col: Column
    type: T.DataType
    binding: Any = None  # the node or edge that it is, if it is one

    def cast(self, kind: T.DataType) -> Expr:
        return self if self.type == kind else Expr(self.col.cast(kind), kind)


def lit(value) -> Expr:
    if value is None:
        return Expr(F.lit(None), NULL)
    if isinstance(value, bool):
        return Expr(F.lit(value), BOOL)
    if isinstance(value, int):
        return Expr(F.lit(value).cast("long"), LONG)
    if isinstance(value, float):
        return Expr(F.lit(value), DOUBLE)
    return Expr(F.lit(str(value)), STRING)


def is_integer(t) -> bool:
    return isinstance(t, (T.LongType, T.IntegerType, T.ShortType, T.ByteType))


def is_number(t) -> bool:
    return isinstance(t, T.NumericType)


def is_string(t) -> bool:
    return isinstance(t, T.StringType)


def is_bool(t) -> bool:
    return isinstance(t, T.BooleanType)


def is_list(t) -> bool:
    return isinstance(t, T.ArrayType)


def is_struct(t) -> bool:
    return isinstance(t, T.StructType)


def is_null(t) -> bool:
    return isinstance(t, T.NullType)


def is_time(t) -> bool:
    return isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType))


def field(t: T.StructType, name: str) -> T.StructField | None:
    return next((f for f in t.fields if f.name == name), None)


def common(types: list[T.DataType]) -> T.DataType:
    """The type that values of all these types can have together; strings if nothing else."""
    kinds = [t for t in types if not is_null(t)]
    if not kinds:
        return NULL
    first = kinds[0]
    if all(t == first for t in kinds):
        return first
    if all(is_number(t) for t in kinds):
        return LONG if all(is_integer(t) for t in kinds) else DOUBLE
    if all(is_list(t) for t in kinds):
        return T.ArrayType(common([t.elementType for t in kinds]))
    if all(is_struct(t) for t in kinds):
        names: dict[str, list] = {}
        for t in kinds:
            for f in t.fields:
                names.setdefault(f.name, []).append(f.dataType)
        return T.StructType([T.StructField(n, common(ts)) for n, ts in names.items()])
    return STRING


def convert(e: Expr, to: T.DataType) -> Column:
    """The column as that type; structs get missing fields as null, and anything can become a string."""
    if e.type == to:
        return e.col
    if is_null(e.type):
        return F.lit(None).cast(to)
    if is_string(to):
        return text(e).col
    if is_struct(to) and is_struct(e.type):
        parts = []
        for f in to.fields:
            own = field(e.type, f.name)
            parts.append((convert(Expr(e.col.getField(f.name), own.dataType), f.dataType) if own else F.lit(None).cast(f.dataType)).alias(f.name))
        return F.when(e.col.isNotNull(), F.struct(*parts))
    if is_list(to) and is_list(e.type):
        return F.transform(e.col, lambda x: convert(Expr(x, e.type.elementType), to.elementType))
    return e.col.cast(to)


def array(items: list[Expr]) -> Expr:
    kind = common([x.type for x in items])
    if not items:
        return Expr(F.array().cast(T.ArrayType(STRING)), T.ArrayType(NULL))
    if is_null(kind):
        return Expr(F.array(*[F.lit(None).cast(STRING) for _ in items]), T.ArrayType(STRING))
    return Expr(F.array(*[convert(x, kind) for x in items]), T.ArrayType(kind))


def number_text(col: Column) -> Column:
    """A double as text: whole numbers without a point."""
    whole = (col == F.floor(col)) & (F.abs(col) < 1e15)
    return F.when(whole, col.cast("long").cast("string")).otherwise(col.cast("string"))


def iso(e: Expr) -> Column:
    """A timestamp or date column as ISO text."""
    if isinstance(e.type, T.DateType):
        return F.date_format(e.col, "yyyy-MM-dd")
    return F.date_format(e.col, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def text(e: Expr) -> Expr:
    if is_string(e.type):
        return e
    if is_number(e.type) and not is_integer(e.type):
        return Expr(number_text(e.col.cast("double")), STRING)
    if is_time(e.type):
        return Expr(iso(e), STRING)
    if is_struct(e.type) or is_list(e.type) or isinstance(e.type, T.MapType):
        return Expr(F.to_json(e.col), STRING) if not (is_list(e.type) and is_null(e.type.elementType)) else Expr(F.when(e.col.isNotNull(), F.lit("[]")), STRING)
    return Expr(e.col.cast("string"), STRING)


def chars(col: Column) -> Column:
    return F.filter(F.split(col, ""), lambda c: c != "")


def as_list(e: Expr) -> Expr:
    """Lists as they are, strings as lists of characters, null as null, other values as a list of one."""
    if is_list(e.type):
        return e
    if is_string(e.type):
        return Expr(chars(e.col), T.ArrayType(STRING))
    if is_null(e.type):
        return Expr(F.lit(None).cast(T.ArrayType(STRING)), T.ArrayType(NULL))
    return Expr(F.when(e.col.isNotNull(), F.array(e.col)), T.ArrayType(e.type))


def number(e: Expr) -> Expr | None:
    """The value as a number, or None if its type never is one."""
    if is_number(e.type):
        return e if is_integer(e.type) or isinstance(e.type, T.DoubleType) else Expr(e.col.cast("double"), DOUBLE)
    if is_bool(e.type):
        return Expr(e.col.cast("long"), LONG)
    if is_string(e.type):
        return Expr(F.expr("try_cast(null as double)") if e.col is None else e.col.try_cast("double"), DOUBLE)
    return None


def truth(e: Expr) -> Column:
    """Two-valued truth of any value: null, 0, '' and false are false."""
    if is_bool(e.type):
        return F.coalesce(e.col, F.lit(False))
    if is_null(e.type):
        return F.lit(False)
    if is_number(e.type):
        return F.coalesce((e.col != 0) & ~F.isnan(e.col.cast("double")), F.lit(False))
    if is_string(e.type):
        return F.coalesce(e.col != "", F.lit(False))
    return e.col.isNotNull()
