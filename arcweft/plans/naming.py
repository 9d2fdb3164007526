"""Names of result columns that have no alias."""

from __future__ import annotations

from .. import ast as A


def describe(n) -> str:
    if isinstance(n, A.Var):
        return n.name
    if isinstance(n, A.Prop):
        return n.key
    if isinstance(n, A.CountStar):
        return "count(*)"
    if isinstance(n, A.Call):
        if n.name in ("count", "sum", "avg", "min", "max", "collect"):
            return f"{n.name.upper()}({full(n.args[0]) if n.args else ''})"
        return f"{n.name}({', '.join(describe(a) for a in n.args)})"
    if isinstance(n, A.CountPattern):
        return "COUNT(pattern)"
    if isinstance(n, A.Literal):
        return {None: "null", True: "true", False: "false"}.get(n.value, str(n.value)) if n.value is None or isinstance(n.value, bool) else str(n.value)
    if isinstance(n, A.Reduce):
        return "reduce()"
    if isinstance(n, A.Slice):
        return f"{describe(n.base)}[]"
    if isinstance(n, A.ListExpr):
        return "list"
    if isinstance(n, A.MapExpr):
        return "map"
    if isinstance(n, A.Case):
        return "CASE"
    if isinstance(n, A.ShortestPath):
        return "allShortestPaths()" if n.every else "shortestPath()"
    if isinstance(n, A.Quantifier):
        return f"{n.kind}()"
    if isinstance(n, (A.Comprehension, A.PatternComprehension)):
        return "[...]"
    if isinstance(n, A.Unary):
        return f"{n.op}{describe(n.arg)}" if n.op in "+-" else "EXISTS()"
    if isinstance(n, A.Binary):
        return f"{describe(n.left)} {n.op} {describe(n.right)}"
    if isinstance(n, A.Index):
        return f"{describe(n.base)}[]"
    return "value"


def full(n) -> str:
    """An aggregate's argument, with the variable of a property."""
    return f"{full(n.base)}.{n.key}" if isinstance(n, A.Prop) else describe(n)


def default_names(items) -> list[str]:
    """Aliases; for the others the property or a description, made unique by the variable or a number."""
    counts: dict[str, int] = {}
    for i in items:
        if i.alias is None:
            counts[describe(i.expr)] = counts.get(describe(i.expr), 0) + 1
    used, out = set(), []
    for i in items:
        name = i.alias
        if name is None:
            name = describe(i.expr)
            if counts[name] > 1 and isinstance(i.expr, A.Prop):
                name = full(i.expr)
            base, k = name, 1
            while name in used:
                name, k = f"{base}_{k}", k + 1
        used.add(name)
        out.append(name)
    return out
