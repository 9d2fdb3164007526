"""User-defined functions, called in queries as namespace.name(arguments)."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import QueryError
from .typed import Expr, is_null


class FunctionError(QueryError):
    """Raised by a user-defined function for arguments that it can't take."""


def _type(kind) -> T.DataType:
    return T._parse_datatype_string(kind) if isinstance(kind, str) else kind


class Registry:
    """Functions by namespace.  Names are not case-sensitive, need a namespace, and are given once."""

    def __init__(self):
        self._functions: dict[str, Callable[[list[Expr]], Expr]] = {}

    def _add(self, namespace: str, name: str, fn):
        if not namespace or not re.fullmatch(r"\w+", namespace) or not re.fullmatch(r"\w+", name or ""):
            raise FunctionError("a function needs a namespace and a name")
        key = f"{namespace}.{name}".lower()
        if key in self._functions:
            raise FunctionError(f"{key} is registered already")
        self._functions[key] = fn

    def add_function(self, namespace: str, name: str, fn: Callable, returns="string", vectorized: bool = False):
        """A Python function of values, or with ``vectorized`` one of pandas Series; rows travel in Arrow batches either way."""
        kind = _type(returns)
        udf = F.pandas_udf(fn, kind) if vectorized else F.udf(fn, kind, useArrow=True)
        self._add(namespace, name, lambda args: Expr(udf(*[a.col.cast("string") if is_null(a.type) else a.col for a in args]), kind))

    def add_column_function(self, namespace: str, name: str, fn: Callable, returns="string"):
        """A function from Spark columns to a Spark column: stays inside the JVM."""
        kind = _type(returns)
        self._add(namespace, name, lambda args: Expr(fn(*[a.col for a in args]), kind))

    # an aggregation is called on its arguments, usually lists gathered with collect()
    add_aggregation = add_function

    def names(self) -> list[str]:
        return sorted(self._functions)

    def find(self, name: str):
        return self._functions.get(name.lower())


REGISTRY = Registry()
register_function = REGISTRY.add_function
register_column_function = REGISTRY.add_column_function
