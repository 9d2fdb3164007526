"""Compiles expressions of the syntax tree to typed Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import ast as A
from ..errors import QueryError
from ..functions import scalar, temporal
from ..functions.registry import REGISTRY
from ..functions.typed import (
    BOOL, DOUBLE, LONG, NULL, STRING, Expr, array, as_list, common, convert, field, is_bool, is_integer, is_list, is_null, is_number, is_string, is_struct, is_time, iso, lit, number, text, truth,
)
from .bindings import Edge, Node, Value, is_edge_type, is_node_type, is_path_type

FALSE = F.lit
AGGREGATES = frozenset(["count", "sum", "avg", "min", "max", "collect"])


def is_aggregate(node) -> bool:
    return isinstance(node, (A.CountStar, A.CountPattern)) or (isinstance(node, A.Call) and node.name in AGGREGATES)


def has_aggregate(node) -> bool:
    return any(is_aggregate(x) for x in A.walk(node))


class Compiler:
    """Compiles against the variables of a frame; ``hooks`` supplies columns for nodes that need a join first.

    A hook maps a syntax node (a pattern comprehension, a shortest path, a graph function, an aggregate) to the
    typed column that holds its value.
    """

    def __init__(self, variables: dict, hooks: dict | None = None):
        self.variables = variables
        self.hooks = hooks or {}

    def nested(self, **more) -> Compiler:
        return Compiler({**self.variables, **more}, self.hooks)

    # ---- values

    def value(self, node) -> Expr:
        """The typed value; nodes and edges become structs."""
        e = self.compile(node)
        return self.plain(e)

    def plain(self, e: Expr) -> Expr:
        return e.binding.struct() if isinstance(e.binding, (Node, Edge)) else e

    def compile(self, node) -> Expr:
        if node in self.hooks:
            return self.hooks[node]
        rule = getattr(self, f"_{type(node).__name__.lower()}", None)
        if rule is None:
            raise QueryError(f"{type(node).__name__} can't be used here")
        return rule(node)

    def _literal(self, n):
        return lit(n.value)

    def _var(self, n):
        b = self.variables.get(n.name)
        if b is None:
            raise QueryError(f"unknown variable {n.name}")
        if isinstance(b, Expr):
            return b
        if isinstance(b, Value):
            return b.expr()
        return Expr(F.col(b.key if isinstance(b, Node) else b.source), NULL, b)

    def _prop(self, n):
        base = self.compile(n.base)
        if isinstance(base.binding, (Node, Edge)):
            return base.binding.prop(n.key)
        if is_struct(base.type):
            f = field(base.type, n.key)
            if f is not None:
                return Expr(base.col.getField(n.key), f.dataType)
            if n.key == "label" and is_node_type(base.type):
                return Expr(F.get(base.col.getField("labels"), F.lit(0)), STRING)
        elif isinstance(base.type, T.MapType):
            return Expr(F.try_element_at(base.col, F.lit(n.key)), base.type.valueType)
        elif is_time(base.type) and n.key.lower() in temporal.PARTS:
            return temporal.component(base, n.key.lower())
        return Expr(F.lit(None), NULL)

    def _listexpr(self, n):
        return array([self.value(x) for x in n.items])

    def _mapexpr(self, n):
        if not n.items:
            return Expr(F.struct(F.lit(None).cast("string").alias("__none")), T.StructType([]))
        got = [(k, self.value(v)) for k, v in n.items]
        return Expr(F.struct(*[(e.col.cast(STRING) if is_null(e.type) else e.col).alias(k) for k, e in got]), T.StructType([T.StructField(k, STRING if is_null(e.type) else e.type) for k, e in got]))

    def _index(self, n):
        base = self.value(n.base)
        if (is_struct(base.type) or isinstance(base.type, T.MapType)) and isinstance(n.index, A.Literal):
            return self._prop(A.Prop(n.base, n.index.value))
        return scalar.index(base, self.value(n.index))

    def _slice(self, n):
        return scalar.cut(self.value(n.base), self.value(n.start) if n.start is not None else None, self.value(n.end) if n.end is not None else None)

    # ---- operators

    def _unary(self, n):
        if n.op == "NOT":
            return Expr(~truth(self.test(n.arg)), BOOL)
        if n.op in ("ISNULL", "NOTNULL"):
            e = self.compile(n.arg)
            return Expr(e.col.isNull() if n.op == "ISNULL" else e.col.isNotNull(), BOOL)
        x = number(self.value(n.arg))
        if x is None:
            return Expr(F.lit(None).cast("double"), DOUBLE)
        return Expr(-x.col, x.type) if n.op == "-" else x

    def test(self, node) -> Expr:
        """A node as a condition: nodes and edges are true when bound."""
        e = self.compile(node)
        return Expr(e.col.isNotNull(), BOOL) if e.binding is not None else e

    def condition(self, node) -> Column:
        """Two-valued truth of a condition."""
        return truth(self.test(node))

    def keeps(self, node) -> Column:
        """A condition for a filter or a join, where null counts as false already.

        Comparisons stay bare under AND and OR, so that they reach the scans as pushed filters.
        """
        if isinstance(node, A.Binary) and node not in self.hooks:
            if node.op in ("AND", "OR"):
                a, b = self.keeps(node.left), self.keeps(node.right)
                return a & b if node.op == "AND" else a | b
            if node.op == "=":
                return self._equal(node.left, node.right, False)
            if node.op == "<>":
                a, b = self.compile(node.left), self.compile(node.right)
                plain = a.binding is None and b.binding is None and (type(a.type) is type(b.type) or (is_number(a.type) and is_number(b.type)))
                return a.col != b.col if plain and not is_struct(a.type) and not is_list(a.type) and not is_null(a.type) else self._equal(node.left, node.right, True)
            if node.op in ("<", "<=", ">", ">="):
                return order(self.value(node.left), self.value(node.right), node.op)
            if node.op == "IN" and isinstance(node.right, A.ListExpr) and node.right.items and all(isinstance(x, A.Literal) and x.value is not None for x in node.right.items):
                a, values = self.compile(node.left), [x.value for x in node.right.items]
                kinds = {type(v) for v in values}
                if a.binding is None and ((is_string(a.type) and kinds == {str}) or (is_number(a.type) and kinds <= {int, float})):
                    return a.col.isin(*values)
            if node.op in ("CONTAINS", "STARTS", "ENDS"):
                x, y = text(self.value(node.left)).col, text(self.value(node.right)).col
                return {"CONTAINS": x.contains, "STARTS": x.startswith, "ENDS": x.endswith}[node.op](y)
        return self.condition(node)

    def _binary(self, n):
        op = n.op
        if op in ("AND", "OR", "XOR"):
            a, b = self.condition(n.left), self.condition(n.right)
            return Expr({"AND": a & b, "OR": a | b, "XOR": a != b}[op], BOOL)
        if op in ("=", "<>"):
            return Expr(F.coalesce(self._equal(n.left, n.right, op == "<>"), F.lit(False)), BOOL)
        if op == "IN":
            return self._in(n)
        a, b = self.value(n.left), self.value(n.right)
        if op in ("<", "<=", ">", ">="):
            return Expr(F.coalesce(order(a, b, op), F.lit(False)), BOOL)
        if op in ("CONTAINS", "STARTS", "ENDS"):
            x, y = text(a).col, text(b).col
            got = {"CONTAINS": x.contains, "STARTS": x.startswith, "ENDS": x.endswith}[op](y)
            return Expr(F.coalesce(got, F.lit(False)), BOOL)
        return arithmetic(a, op, b)

    def _equal(self, left, right, negated: bool) -> Column:
        a, b = self.compile(left), self.compile(right)
        if a.binding is not None or b.binding is not None:
            same = self._same(a, b)
        else:
            same = equal(a, b)
        if not negated:
            return same
        # a null on either side makes <> false too
        return F.when(a.col.isNotNull() & b.col.isNotNull(), ~F.coalesce(same, F.lit(False)))

    def _same(self, a: Expr, b: Expr) -> Column:
        x, y = a.binding, b.binding
        if isinstance(x, Node) and isinstance(y, Node):
            return same_node(x, y)
        if isinstance(x, Edge) and isinstance(y, Edge):
            return x.id() == y.id()
        e, other = (a, b) if x is not None else (b, a)
        if is_struct(other.type):
            if is_node_type(other.type) or is_edge_type(other.type):
                return e.binding.id() == other.col.getField("id")
            return equal(self.plain(e), other)  # a node has the entries of a map
        return F.lit(False)

    def _in(self, n):
        a, b = self.compile(n.left), as_list(self.value(n.right))
        kind = b.type.elementType
        if is_node_type(kind) or is_edge_type(kind):
            key = a.binding.id() if a.binding is not None else a.col.getField("id") if is_struct(a.type) else F.lit(None).cast("string")
            return Expr(F.coalesce(F.exists(b.col, lambda x: F.coalesce(x.getField("id") == key, F.lit(False))), F.lit(False)), BOOL)
        a = self.plain(a)
        if is_null(kind) or is_null(a.type):
            return Expr(F.lit(False), BOOL)
        if (a.type == kind or (is_number(a.type) and is_number(kind))) and not is_struct(kind):
            return Expr(F.coalesce(F.array_contains(convert(b, T.ArrayType(common([a.type, kind]))), convert(a, common([a.type, kind]))), F.lit(False)), BOOL)
        return Expr(F.coalesce(a.col.isNotNull() & F.exists(b.col, lambda x: F.coalesce(equal(a, Expr(x, kind)), F.lit(False))), F.lit(False)), BOOL)

    def _haslabel(self, n):
        e = self.compile(n.base)
        if isinstance(e.binding, Edge):
            return Expr(F.coalesce(e.binding.type_of().isin([x for c in n.labels.any_of for x, _ in c]), F.lit(False)), BOOL)
        if isinstance(e.binding, Node):
            labels = e.binding.labels_column()
        elif is_node_type(e.type):
            labels = e.col.getField("labels")
        else:
            return Expr(F.lit(False), BOOL)
        return Expr(label_test(labels, n.labels), BOOL)

    # ---- branches and lists

    def _case(self, n):
        tests = [self._equal_case(n.subject, w) if n.subject is not None else self.condition(w) for w, _ in n.branches]
        results = [self.value(t) for _, t in n.branches] + ([self.value(n.default)] if n.default is not None else [])
        kind = common([r.type for r in results])
        if is_null(kind):
            return Expr(F.lit(None), NULL)
        out = F.when(tests[0], convert(results[0], kind))
        for t, r in zip(tests[1:], results[1 : len(tests)], strict=True):
            out = out.when(t, convert(r, kind))
        if n.default is not None:
            out = out.otherwise(convert(results[-1], kind))
        return Expr(out, kind)

    def _equal_case(self, subject, when) -> Column:
        a, b = self.compile(subject), self.compile(when)
        if is_null(b.type) and b.binding is None:
            return a.col.isNull()
        return F.coalesce(self._equal(subject, when, False), F.lit(False))

    def _lambda(self, var: str, kind, x: Column) -> Compiler:
        return self.nested(**{var: Expr(x, kind)})

    def _kept(self, source: Expr, var: str, where) -> Expr:
        if where is None:
            return source
        return Expr(F.filter(source.col, lambda x: self._lambda(var, source.type.elementType, x).condition(where)), source.type)

    def _comprehension(self, n):
        source = self._kept(as_list(self.value(n.source)), n.var, n.where)
        kind = source.type.elementType
        body = self._lambda(n.var, kind, F.lit(None)).value(n.body).type
        to = STRING if is_null(body) else body
        out = F.transform(source.col, lambda x: convert(self._lambda(n.var, kind, x).value(n.body), to))
        return Expr(F.coalesce(out, F.array().cast(T.ArrayType(to))), T.ArrayType(to))

    def _quantifier(self, n):
        source = as_list(self.value(n.source))
        kind = source.type.elementType

        def holds(x):
            return self._lambda(n.var, kind, x).condition(n.where) if n.where is not None else F.lit(True)

        got = {
            "ALL": lambda: F.forall(source.col, holds),
            "ANY": lambda: F.exists(source.col, holds),
            "NONE": lambda: ~F.exists(source.col, holds),
            "SINGLE": lambda: F.size(F.filter(source.col, holds)) == 1,
        }[n.kind]()
        return Expr(F.coalesce(F.when(source.col.isNotNull(), got), F.lit(False)), BOOL)

    def _reduce(self, n):
        init, source = self.value(n.init), as_list(self.value(n.source))
        kind = init.type
        for _ in range(3):  # the accumulator's type is that of the body, found by trying
            scope = self.nested(**{n.acc: Expr(F.lit(None), kind), n.var: Expr(F.lit(None), source.type.elementType)})
            new = common([kind, scope.value(n.body).type])
            if new == kind:
                break
            kind = new
        kind = STRING if is_null(kind) else kind

        def step(acc, x):
            return convert(self.nested(**{n.acc: Expr(acc, kind), n.var: Expr(x, source.type.elementType)}).value(n.body), kind)

        start = convert(init, kind)
        return Expr(F.when(source.col.isNull(), start).otherwise(F.aggregate(source.col, start, step)), kind)

    # ---- functions

    def _call(self, n):
        name = n.name
        if name in AGGREGATES:
            raise QueryError(f"{name}() can't be used here")
        if name in ("id", "labels", "labelsof", "type", "reltype", "startnode", "endnode", "nodes", "relationships", "keys", "properties"):
            return getattr(self, f"_fn_{name}")(self.compile(n.args[0]))
        if "." in name:
            fn = REGISTRY.find(name)
            if fn is None:
                raise QueryError(f"unknown function {name}()")
            return fn([self.value(a) for a in n.args])
        if name == "exists":
            return Expr(self.compile(n.args[0]).col.isNotNull(), BOOL)
        return scalar.call(name, [self.value(a) for a in n.args])

    def _field(self, e: Expr, name: str, of_binding, kind=STRING) -> Expr:
        if e.binding is not None:
            return Expr(of_binding(e.binding), kind)
        if is_struct(e.type) and field(e.type, name):
            return Expr(e.col.getField(name), kind)
        if is_list(e.type) and is_struct(e.type.elementType) and field(e.type.elementType, name):
            return Expr(F.transform(e.col, lambda x: x.getField(name)), T.ArrayType(kind))
        return Expr(F.lit(None).cast(kind), kind)

    def _fn_id(self, e):
        return self._field(e, "id", lambda b: F.when(e.col.isNotNull(), b.id()))

    def _fn_labels(self, e):
        return self._field(e, "labels", lambda b: b.labels_column() if isinstance(b, Node) else F.array(b.type_of()), T.ArrayType(STRING))

    _fn_labelsof = _fn_labels

    def _fn_reltype(self, e):
        return self._field(e, "type", lambda b: b.type_of() if isinstance(b, Edge) else F.lit(None).cast("string"))

    _fn_type = _fn_reltype

    def _fn_startnode(self, e):
        return self._field(e, "source", lambda b: b.source_id() if isinstance(b, Edge) else F.lit(None).cast("string"))

    def _fn_endnode(self, e):
        return self._field(e, "target", lambda b: b.target_id() if isinstance(b, Edge) else F.lit(None).cast("string"))

    def _fn_nodes(self, e):
        if isinstance(e.binding, Node) or is_node_type(e.type):
            return array([self.plain(e)])
        if is_path_type(e.type):
            return Expr(e.col.getField("nodes"), field(e.type, "nodes").dataType)
        return e if is_list(e.type) else Expr(F.lit(None).cast("array<string>"), T.ArrayType(STRING))

    def _fn_relationships(self, e):
        if isinstance(e.binding, Edge) or is_edge_type(e.type):
            return array([self.plain(e)])
        if is_path_type(e.type):
            return Expr(e.col.getField("relationships"), field(e.type, "relationships").dataType)
        return e if is_list(e.type) else Expr(F.lit(None).cast("array<string>"), T.ArrayType(STRING))

    def _fn_keys(self, e):
        if e.binding is not None:
            names = [F.when(F.col(c).isNotNull(), F.lit(p)) for p, (c, _) in sorted(e.binding.props.items())]
            return Expr(F.when(e.col.isNotNull(), F.array_compact(F.array(*names)) if names else F.array().cast("array<string>")), T.ArrayType(STRING))
        return scalar.keys(e)

    def _fn_properties(self, e):
        if e.binding is not None:
            props = sorted(e.binding.props.items())
            return Expr(F.struct(*[F.col(c).alias(p) for p, (c, _) in props]), T.StructType([T.StructField(p, t) for p, (_, t) in props]))
        return e


def same_node(a: Node, b: Node) -> Column:
    if a.space == b.space:
        return F.col(a.key) == F.col(b.key)
    if a.space and b.space:
        return F.lit(False)
    return a.id() == b.id()


def label_test(labels: Column, term: A.LabelTerm) -> Column:
    out = F.lit(False)
    for conj in term.any_of:
        one = F.lit(True)
        for name, negated in conj:
            has = F.coalesce(F.array_contains(labels, name), F.lit(False))
            one = one & (~has if negated else has)
        out = out | one
    return out


def equal(a: Expr, b: Expr) -> Column:
    """Equality of values: false for different types; a map equals one that has its entries."""
    if is_null(a.type) or is_null(b.type):
        return F.lit(False)
    if is_number(a.type) and is_number(b.type):
        return a.col == b.col
    if is_time(a.type) and is_string(b.type):
        return a.col == b.col.try_cast(a.type)
    if is_time(b.type) and is_string(a.type):
        return b.col == a.col.try_cast(b.type)
    if is_struct(a.type) and is_struct(b.type):
        if (is_node_type(a.type) and is_node_type(b.type)) or (is_edge_type(a.type) and is_edge_type(b.type)):
            return a.col.getField("id") == b.col.getField("id")
        out = a.col.isNotNull() & b.col.isNotNull()
        for f in b.type.fields:
            own = field(a.type, f.name)
            out = out & (F.coalesce(equal(Expr(a.col.getField(f.name), own.dataType), Expr(b.col.getField(f.name), f.dataType)), F.lit(False)) if own else F.lit(False))
        return out
    if is_list(a.type) and is_list(b.type):
        x, y = a.type.elementType, b.type.elementType
        if x == y and not is_struct(x):
            return F.coalesce(a.col == b.col, F.lit(False)) if not is_null(x) else (F.size(a.col) == 0) & (F.size(b.col) == 0)
        pairs = F.zip_with(a.col, b.col, lambda p, q: F.coalesce(equal(Expr(p, x), Expr(q, y)), F.lit(False)))
        return (F.size(a.col) == F.size(b.col)) & F.forall(pairs, lambda z: z)
    if type(a.type) is type(b.type):
        return a.col == b.col
    return F.lit(False)


def order(a: Expr, b: Expr, op: str) -> Column:
    """Comparison of two numbers, two texts (by time if both are temporal) or two times; others can't be compared."""
    one = {"<": lambda x, y: x < y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y}[op]
    if is_null(a.type) or is_null(b.type):
        return F.lit(False)
    if is_number(a.type) and is_number(b.type):
        return one(a.col, b.col)
    if is_time(a.type) and (is_string(b.type) or is_time(b.type)):
        return one(a.col, b.col.try_cast(a.type))
    if is_time(b.type) and is_string(a.type):
        return one(a.col.try_cast(b.type), b.col)
    if is_string(a.type) and is_string(b.type):
        return temporal.later(a.col, b.col, op)
    raise QueryError(f"{op} compares numbers or strings, not {a.type.simpleString()} and {b.type.simpleString()}")


def arithmetic(a: Expr, op: str, b: Expr) -> Expr:
    if op == "+":
        if is_string(a.type) and is_string(b.type):
            return Expr(F.concat(a.col, b.col), STRING)
        if is_list(a.type) and (is_list(b.type) or not is_string(b.type)) or is_list(b.type) and not is_string(a.type):
            x, y = as_list(a), as_list(b)
            kind = common([x.type, y.type])
            return Expr(F.concat(convert(x, kind), convert(y, kind)), kind)
    x, y = number(iso_text(a)), number(iso_text(b))
    if x is None or y is None or is_null(a.type) or is_null(b.type):
        return Expr(F.lit(None).cast("double"), DOUBLE)
    whole = is_integer(x.type) and is_integer(y.type)
    if op == "/":
        return Expr(F.when(y.col != 0, x.col.cast("double") / y.col.cast("double")), DOUBLE)
    if op == "%":
        return Expr(F.when(y.col != 0, x.col % y.col), LONG if whole else DOUBLE)
    if op == "^":
        return Expr(F.pow(x.col.cast("double"), y.col.cast("double")), DOUBLE)
    return Expr({"+": x.col + y.col, "-": x.col - y.col, "*": x.col * y.col}[op], LONG if whole else DOUBLE)


def iso_text(e: Expr) -> Expr:
    return Expr(iso(e), STRING) if is_time(e.type) else e


def sort_columns(e: Expr, descending: bool, nulls_first: bool | None) -> list[Column]:
    """Sort columns of a key: nulls last ascending and first descending unless said; true before false."""
    first = descending if nulls_first is None else nulls_first
    c = e.col
    if is_null(e.type):
        return []
    if is_bool(e.type):
        c = ~c
    elif is_list(e.type) or is_struct(e.type) or isinstance(e.type, T.MapType):
        c = text(e).col
    columns = [c]
    if is_string(e.type):  # texts that are times sort by time
        columns = [F.when(temporal.is_temporal(c), temporal.temporal_epoch(e).col), c] if _maybe_temporal(c) else [c]
    out = []
    for x in columns:
        out.append((x.desc_nulls_first() if first else x.desc_nulls_last()) if descending else (x.asc_nulls_first() if first else x.asc_nulls_last()))
    return out


def _maybe_temporal(column: Column) -> bool:
    """Whether a text column is built by a temporal function (stored texts in ISO form sort alike as text)."""
    return "date_format" in str(column)
