"""Scalar functions by their lower-case names: each takes typed arguments and gives a typed column."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import QueryError
from . import temporal
from .typed import BOOL, DOUBLE, LONG, NULL, STRING, Expr, array, as_list, common, convert, is_integer, is_list, is_null, is_number, is_string, is_struct, text, truth

SPACE = r"[\s ﻿  -     　]+"


def _text(e: Expr):
    return text(e).col


def _none(kind) -> Expr:
    return Expr(F.lit(None).cast(kind), kind)


def substring(s: Expr, start: Expr, end: Expr | None = None) -> Expr:
    """Characters from ``start`` up to ``end``; out of range is cut off, and swapped ends are swapped back."""
    c = _text(s)
    n = F.length(c).cast("long")

    def clamp(x):
        return F.greatest(F.lit(0).cast("long"), F.least(n, x.col.cast("long")))

    a = clamp(start)
    b = clamp(end) if end is not None else n
    return Expr(F.substring(c, F.least(a, b).cast("int") + 1, F.abs(b - a).cast("int")), STRING)


def size(e: Expr) -> Expr:
    if is_list(e.type):
        return Expr(F.when(e.col.isNotNull(), F.size(e.col)).cast("long"), LONG)
    if is_struct(e.type) and e.type.fieldNames() == ["nodes", "relationships"]:
        return Expr(F.when(e.col.isNotNull(), F.size(e.col.getField("relationships"))).cast("long"), LONG)
    if is_null(e.type):
        return _none(LONG)
    return Expr(F.length(_text(e)).cast("long"), LONG)


def element(e: Expr, position: int) -> Expr:
    x = as_list(e)
    return Expr(F.try_element_at(x.col, F.lit(position)), x.type.elementType)


def index(e: Expr, i: Expr) -> Expr:
    """The element at an index from 0, counted from the end if negative; null out of range."""
    x = as_list(e)
    at = i.col.cast("int")
    if not is_number(i.type):
        if is_struct(e.type) and is_string(i.type):
            raise QueryError("a map's key must be written as a name")
        return _none(x.type.elementType)
    return Expr(F.when(at.isNotNull(), F.try_element_at(x.col, F.when(at >= 0, at + 1).otherwise(at))), x.type.elementType)


def cut(e: Expr, start: Expr | None, end: Expr | None) -> Expr:
    """The half-open slice of a list or string; negative ends count from the end."""
    whole = as_list(e)
    n = F.size(whole.col)

    def at(x: Expr | None, default):
        if x is None:
            return default
        i = x.col.cast("int")
        return F.greatest(F.lit(0), F.least(n, F.when(i < 0, n + i).otherwise(i)))

    a, b = at(start, F.lit(0)), at(end, n)
    out = F.slice(whole.col, a + 1, F.greatest(F.lit(0), b - a))
    return Expr(F.array_join(out, ""), STRING) if is_string(e.type) else Expr(out, whole.type)


def to_string(e: Expr) -> Expr:
    return text(e)


def to_integer(e: Expr) -> Expr:
    if is_number(e.type):
        c = e.col
        return Expr(c.cast("long") if is_integer(e.type) else F.when(F.isnan(c), None).otherwise(F.when(c < 0, F.ceil(c)).otherwise(F.floor(c))).cast("long"), LONG)
    if e.type == BOOL:
        return Expr(F.lit(None).cast("long"), LONG)
    return Expr(F.regexp_extract(_text(e), r"^\s*([+-]?\d+)", 1).try_cast("long"), LONG)


def to_float(e: Expr) -> Expr:
    if is_number(e.type):
        return Expr(e.col.cast("double"), DOUBLE)
    return Expr(F.regexp_extract(_text(e), r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1).try_cast("double"), DOUBLE)


def to_boolean(e: Expr) -> Expr:
    return Expr(F.when(e.col.isNotNull(), truth(e)), BOOL)


def coalesce(*args: Expr) -> Expr:
    kind = common([a.type for a in args])
    if is_null(kind):
        return Expr(F.lit(None), NULL)
    return Expr(F.coalesce(*[convert(a, kind) for a in args]), kind)


def keys(e: Expr) -> Expr:
    """Names of a map's entries that have a value; of a node or edge those of its properties."""
    if isinstance(e.type, T.MapType):
        return Expr(F.map_keys(e.col), T.ArrayType(STRING))
    if not is_struct(e.type):
        return _none(T.ArrayType(STRING))
    names = [F.when(e.col.getField(f.name).isNotNull(), F.lit(f.name)) for f in e.type.fields]
    return Expr(F.when(e.col.isNotNull(), F.array_compact(F.array(*names)) if names else F.array().cast("array<string>")), T.ArrayType(STRING))


def reverse(e: Expr) -> Expr:
    return Expr(F.reverse(e.col), e.type) if is_list(e.type) else Expr(F.reverse(_text(e)), STRING)


def tail(e: Expr) -> Expr:
    if is_list(e.type):
        x = as_list(e)
        return Expr(F.slice(x.col, F.lit(2), F.greatest(F.lit(0), F.size(x.col) - 1)), x.type)
    return Expr(F.substring(_text(e), 2, 1 << 30), STRING)


def _split(s: Expr, d: Expr) -> Expr:
    c, by = _text(s), _text(d)
    parts = F.split(c, F.concat(F.lit("\\Q"), by, F.lit("\\E")), -1)
    return Expr(F.when(by == "", F.filter(F.split(c, ""), lambda x: x != "")).otherwise(parts), T.ArrayType(STRING))


SIMPLE = {
    "tolower": lambda s: Expr(F.lower(_text(s)), STRING),
    "toupper": lambda s: Expr(F.upper(_text(s)), STRING),
    "substring": substring,
    "split": _split,
    "repl": lambda s, a, b: Expr(F.replace(_text(s), _text(a), _text(b)), STRING),
    "trim": lambda s: Expr(F.regexp_replace(_text(s), f"^{SPACE}|{SPACE}$", ""), STRING),
    "ltrim": lambda s: Expr(F.regexp_replace(_text(s), f"^{SPACE}", ""), STRING),
    "rtrim": lambda s: Expr(F.regexp_replace(_text(s), f"{SPACE}$", ""), STRING),
    "length": size,
    "size": size,
    "head": lambda e: element(e, 1),
    "last": lambda e: element(e, -1),
    "tail": tail,
    "reverse": reverse,
    "coalesce": coalesce,
    "tostring": to_string,
    "tointeger": to_integer,
    "toint": to_integer,
    "tofloat": to_float,
    "toboolean": to_boolean,
    "keys": keys,
    "random": lambda: Expr(F.rand(), DOUBLE),
    "timestamp": lambda: Expr(F.unix_timestamp(), LONG),
    "temporalepoch": temporal.temporal_epoch,
    "duration": lambda *a: temporal.duration(list(a)),
}
SIMPLE |= {k: (lambda k: lambda *a: temporal.build(k, list(a)))(k) for k in temporal.KINDS}
SIMPLE |= {k: (lambda k: lambda e: temporal.component(e, k))(k) for k in (*temporal.PARTS, "timezone", "epochseconds", "epochmillisecond")}
SIMPLE |= {k: (lambda k: lambda e: temporal.duration_part(e, k))(k) for k in ("totalseconds", "totalminutes")}
SIMPLE |= {f"duration{k}": (lambda k: lambda e: temporal.duration_part(e, k))(k) for k in ("years", "months", "days", "hours", "minutes", "seconds", "milliseconds")}


def call(name: str, args: list[Expr]) -> Expr:
    fn = SIMPLE.get(name)
    if fn is None:
        raise QueryError(f"unknown function {name}()")
    try:
        return fn(*args)
    except TypeError as e:
        if "positional argument" in str(e):
            raise QueryError(f"wrong number of arguments for {name}()") from None
        raise


__all__ = ["array", "call", "cut", "index", "size"]
