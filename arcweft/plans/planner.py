"""Plans queries: each clause turns a frame of rows into the next."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import ast as A
from ..errors import QueryError
from ..functions.typed import BOOL, DOUBLE, LONG, NULL, STRING, Expr, as_list, common, convert, is_integer, is_null, is_number, lit, number
from ..graph import PropertyGraph
from ..operators import analytics, paths
from ..operators.cutting import cut_lineage
from ..parser import parse
from ..sources.csv import read_csv
from .bindings import Edge, Frame, Node, Value, fresh
from .expressions import Compiler, has_aggregate, is_aggregate, same_node, sort_columns
from .match import Matcher
from .naming import default_names
from .needs import ALL, needs

JOINED = (A.PatternComprehension, A.CountPattern, A.PatternPredicate, A.ShortestPath)


def run(graph: PropertyGraph, text: str | A.Query) -> tuple[DataFrame, PropertyGraph]:
    """Rows of a query and the graph that it leaves."""
    query = parse(text) if isinstance(text, str) else text
    query = looked_up(query)
    planner = Planner(graph, needs(query))
    if any(isinstance(x, A.WRITES) for x in A.walk(query)):
        planner.graph = graph.generic()
        planner.writing = True
    return planner.query(query), planner.graph


def looked_up(query: A.Query) -> A.Query:
    """The query without maps of scores that are only counted or asked for single nodes: these are looked up instead.

    ``WITH f() AS m`` with nothing but ``size(keys(m))`` and ``m['id']`` or ``m[id(n)]`` behind it needs no map, which
    one value of any size could be.
    """
    if any(isinstance(x, A.WRITES) for x in A.walk(query)):
        return query
    return replace(query, parts=tuple(_without_maps(q) for q in query.parts))


def _without_maps(q: A.SingleQuery) -> A.SingleQuery:
    for i, c in enumerate(q.clauses):
        for item in c.projection.items if isinstance(c, A.With) else ():
            call, name = item.expr, item.alias
            if not isinstance(call, A.Call) or call.name not in analytics.SCORES or call.args or name is None:
                continue

            def lookup(node, name=name, call=call):
                if isinstance(node, A.Index) and node.base == A.Var(name):
                    key = node.index
                    if (isinstance(key, A.Literal) and isinstance(key.value, str)) or (isinstance(key, A.Call) and key.name == "id"):
                        return replace(call, args=(key,))
                if node == A.Call("size", (A.Call("keys", (A.Var(name),)),)):
                    return A.Call("numnodes", ())
                if isinstance(node, A.Item) and node.expr == A.Var(name) and node.alias in (None, name):
                    return replace(node, expr=A.Literal(0), alias=name)  # handed on, and never read as a map
                return None

            final = q.clauses[-1].projection if isinstance(q.clauses[-1], A.Return) else None
            handed = final is None or final.star or any(x.expr == A.Var(name) for x in final.items)
            here = replace(c, projection=replace(c.projection, items=tuple(replace(x, expr=A.Literal(0)) if x is item else x for x in c.projection.items)))
            rest = _rebuilt(q.clauses[i + 1 :], lookup)
            bound = any(name in (getattr(x, "var", None), getattr(x, "acc", None)) or (isinstance(x, A.Item) and x.alias == name and x.expr != A.Literal(0)) for x in A.walk((c.projection, rest)) if x is not item)
            if handed or bound or A.Var(name) in A.walk(rest) or A.Var(name) in A.walk((c.projection.order, c.projection.where)):
                continue
            return _without_maps(replace(q, clauses=(*q.clauses[:i], here, *rest)))
    return q


def _rebuilt(node, change):
    """A syntax tree with parts replaced where ``change`` gives something."""
    if isinstance(node, tuple):
        return tuple(_rebuilt(x, change) for x in node)
    if not hasattr(node, "__dataclass_fields__"):
        return node
    new = change(node)
    if new is not None:
        return new
    return replace(node, **{f: _rebuilt(getattr(node, f), change) for f in node.__dataclass_fields__})


def special(node):
    """The outermost parts of an expression whose value needs a join."""
    if isinstance(node, JOINED) or (isinstance(node, A.Call) and node.name in analytics.FUNCTIONS) or measure(node):
        yield node
    elif isinstance(node, tuple):
        for x in node:
            yield from special(x)
    elif hasattr(node, "__dataclass_fields__"):
        for name in node.__dataclass_fields__:
            yield from special(getattr(node, name))


def measure(node) -> bool:
    """Whether a value is the length of a shortest path or the number of all: the paths themselves are not read."""
    if not isinstance(node, A.Call) or len(node.args) != 1 or not isinstance(node.args[0], A.ShortestPath):
        return False
    return node.name == ("size" if node.args[0].every else "length")


def conjuncts(node):
    if isinstance(node, A.Binary) and node.op == "AND":
        yield from conjuncts(node.left)
        yield from conjuncts(node.right)
    elif node is not None:
        yield node


def existence(node) -> tuple[A.PatternComprehension, bool] | None:
    """The pattern whose existence (or absence) a condition asks for."""
    if isinstance(node, A.PatternPredicate):
        return A.PatternComprehension(node.path, None, A.Literal(1)), True
    if isinstance(node, A.Unary) and node.op == "NOT" and (inner := existence(node.arg)):
        return inner[0], not inner[1]
    if isinstance(node, A.Binary) and isinstance(node.left, A.Call) and node.left.name in ("size", "length") and len(node.left.args) == 1:
        pattern, n = node.left.args[0], node.right
        if isinstance(pattern, A.PatternComprehension) and isinstance(n, A.Literal):
            asked = {(">", 0): True, (">=", 1): True, ("<>", 0): True, ("=", 0): False, ("<", 1): False, ("<=", 0): False}.get((node.op, n.value))
            if asked is not None:
                return pattern, asked
    return None


def only_counted(m, after) -> bool:
    """Whether the rows of MATCH (a)-[*]-(b) are only counted by what follows, which reads nothing of the paths and of b.

    A start that is picked out by a value has few paths: these are listed, which reads less than counting all.
    """
    if not isinstance(m, A.Match) or m.optional or len(m.paths) != 1 or not isinstance(after, (A.With, A.Return)):
        return False
    path, p = m.paths[0], after.projection
    if path.var or len(path.rels) != 1 or path.rels[0].low is None or path.rels[0].props or any(n.props for n in path.nodes) or p.star:
        return False
    items = [i.expr for i in p.items]
    read = (*items, *[k.expr for k in p.order], m.where, p.where)
    if not any(has_aggregate(e) for e in items) or any(True for _ in special(read)):
        return False
    for n in A.walk(read):
        if isinstance(n, A.CountPattern) or (is_aggregate(n) and isinstance(n, A.Call) and n.name not in ("count", "min", "max") and not n.distinct):
            return False  # a row that stands for several would have to be repeated
    if any(isinstance(n, A.Binary) and n.op in ("=", "IN") for n in A.walk(m.where)):
        return False
    unread = {x.var for x in (path.nodes[1], *path.rels) if x.var}

    def reads(node):
        if isinstance(node, tuple):
            return any(reads(x) for x in node)
        if isinstance(node, A.Var):
            return node.name in unread
        if isinstance(node, A.Call) and node.name == "count" and not node.distinct and len(node.args) == 1 and isinstance(node.args[0], A.Var):
            return False
        return hasattr(node, "__dataclass_fields__") and any(reads(getattr(node, f)) for f in node.__dataclass_fields__)

    return path.nodes[0].var not in unread and not reads(read)


class Planner:
    def __init__(self, graph: PropertyGraph, need: dict):
        self.graph, self.need = graph, need
        self.writing = False
        self.scores: dict = {}  # scores of the graph's nodes, computed once for a query that looks them up often
        self.rid: str | None = None  # inside a subquery: the column that numbers the outer rows
        self.times: str | None = None  # the column of how many rows each row stands for, between a MATCH and its projection

    # ---- queries

    def query(self, q: A.Query) -> DataFrame:
        if len(q.parts) == 1:
            return self.output(self.single(q.parts[0], Frame(None, {})))
        parts, tail = self.without_tail(q)
        frames = [self.output(self.single(p, Frame(None, {}))) for p in parts]
        out = union(frames)
        if not all(q.all_flags):  # one plain UNION makes the whole result distinct
            out = distinct(out)
        return self.tail(out, tail)

    @staticmethod
    def without_tail(q: A.Query):
        """ORDER BY, SKIP and LIMIT of the last branch belong to the union."""
        last = q.parts[-1].clauses[-1]
        if not isinstance(last, A.Return):
            return q.parts, None
        p = last.projection
        names = set(default_names(p.items))
        if p.star or any(isinstance(x, A.Var) and x.name not in names for k in p.order for x in A.walk(k.expr)):
            return q.parts, None  # sorted by what only the branch knows
        bare = A.Return(replace(p, order=(), skip=None, limit=None))
        return (*q.parts[:-1], A.SingleQuery((*q.parts[-1].clauses[:-1], bare))), p

    def tail(self, df: DataFrame, p: A.Projection | None) -> DataFrame:
        if p is None:
            return df
        scope = {f.name: Value(f"`{f.name}`", f.dataType) for f in df.schema.fields}
        keys = [c for k in p.order for c in sort_columns(Compiler(scope).value(k.expr), k.descending, k.nulls_first)]
        df = df.orderBy(*keys) if keys else df
        df = df.offset(p.skip) if p.skip else df
        return df if p.limit is None else df.limit(p.limit)

    def output(self, frame: Frame) -> DataFrame:
        """The result columns; nodes and relationships as structs."""
        if frame.df is None:
            return self.graph.spark.range(0).select()
        scope = Compiler(frame.vars)
        cols = []
        for name in frame.vars:
            e = scope.value(A.Var(name))
            cols.append((e.col.cast("string") if is_null(e.type) else e.col).alias(name))
        return frame.df.select(*cols)

    def single(self, q: A.SingleQuery, frame: Frame) -> Frame:
        if frame.df is None and not self.rid:
            q = self.as_deep_as_needed(q)
        for clause, after in zip(q.clauses, (*q.clauses[1:], None), strict=True):
            if frame.df is None and not frame.vars and only_counted(clause, after):
                matcher = Matcher(self.graph, self.need, counted=True)
                frame, self.times = matcher.match(frame, clause, self.filter), matcher.times
            else:
                frame, self.times = self.clause(clause, frame), None
        if not isinstance(q.clauses[-1], (A.Return, A.CallSubquery)):
            return Frame(None, {})
        return frame

    def as_deep_as_needed(self, q: A.SingleQuery) -> A.SingleQuery:
        """MATCH … RETURN … LIMIT n with a variable-length hop: the shallowest bound that yields n rows.

        Nothing is sorted, grouped or made distinct, so any n rows are the result.  Bounds are tried from the least
        one; each try is limited and costs a fraction of the next.
        """
        if len(q.clauses) != 2 or not isinstance(q.clauses[0], A.Match) or not isinstance(q.clauses[1], A.Return):
            return q
        m, p = q.clauses[0], q.clauses[1].projection
        varying = [(i, j) for i, path in enumerate(m.paths) for j, r in enumerate(path.rels) if r.low is not None]
        if m.optional or len(varying) != 1 or p.order or p.distinct or p.limit is None or self.graph.config.max_paths is not None or any(has_aggregate(x.expr) for x in p.items):
            return q
        i, j = varying[0]
        rel = m.paths[i].rels[j]
        high = rel.high if rel.high >= 0 else self.graph.config.max_var_length_depth
        wanted = p.limit + (p.skip or 0)
        for depth in range(max(1, rel.low), high):
            rels = (*m.paths[i].rels[:j], replace(rel, high=depth), *m.paths[i].rels[j + 1 :])
            paths_ = (*m.paths[:i], replace(m.paths[i], rels=rels), *m.paths[i + 1 :])
            tried = A.SingleQuery((replace(m, paths=paths_), q.clauses[1]))
            bare = A.Return(replace(p, items=(A.Item(A.Literal(1), "one", "one"),), star=False, skip=None, limit=wanted))
            found = Planner(self.graph, self.need)
            if found.output(found.clause(bare, found.clause(tried.clauses[0], Frame(None, {})))).count() >= wanted:
                return tried
        return q

    def rows(self, frame: Frame) -> Frame:
        """The frame with a DataFrame: one empty row to start from."""
        if frame.df is not None:
            return frame
        return Frame(self.graph.spark.range(1).select(F.lit(0).alias(fresh("one"))), frame.vars)

    # ---- clauses

    def clause(self, c, frame: Frame) -> Frame:
        if isinstance(c, A.Match):
            matcher = Matcher(self.graph, self.need)
            if c.optional:
                frame = self.rows(frame)
                return matcher.optional(frame, c, self.join_condition)
            return matcher.match(frame, c, self.filter)
        if isinstance(c, A.With):
            return self.project(self.rows(frame), c.projection)
        if isinstance(c, A.Return):
            return self.project(self.rows(frame), c.projection, final=True)
        if isinstance(c, A.Unwind):
            return self.unwind(self.rows(frame), c)
        if isinstance(c, A.LoadCsv):
            df, kind = read_csv(self.graph.spark, c)
            column = fresh(c.var)
            df = df.select(F.col("row").alias(column))
            return Frame(df if frame.df is None else frame.df.crossJoin(df), {**frame.vars, c.var: Value(column, kind)})
        if isinstance(c, A.CallSubquery):
            return self.call(self.rows(frame), c)
        if isinstance(c, A.WRITES):
            from ..operators.writes import write

            return write(self, self.rows(frame), c)
        raise QueryError(f"{type(c).__name__} is not supported")

    def join_condition(self, frame: Frame, node):
        if any(True for _ in special(node)):
            raise QueryError("an OPTIONAL MATCH condition can't hold a pattern or a graph function")
        return Compiler(frame.vars).keeps(node)

    def filter(self, frame: Frame, node) -> Frame:
        """Rows that meet a condition; existence of a pattern is a semi or anti join."""
        rest = None
        for part in conjuncts(node):
            asked = existence(part)
            if asked:
                frame = self.exists(frame, *asked)
            else:
                rest = part if rest is None else A.Binary("AND", rest, part)
        if rest is None:
            return frame
        frame, hooks = self.prepare(frame, (rest,))
        return Frame(frame.df.where(Compiler(frame.vars, hooks).keeps(rest)), frame.vars)

    def unwind(self, frame: Frame, c: A.Unwind) -> Frame:
        frame, hooks = self.prepare(frame, (c.expr,))
        e = as_list(Compiler(frame.vars, hooks).value(c.expr))
        column = fresh(c.var)
        kind = STRING if is_null(e.type.elementType) else e.type.elementType
        out = Frame(frame.df.withColumn(column, F.explode(e.col)), {**frame.vars, c.var: Value(column, kind)})
        return self.filter(out, c.where) if c.where is not None else out

    # ---- values that need a join

    def prepare(self, frame: Frame, exprs) -> tuple[Frame, dict]:
        hooks: dict = {}
        for node in special(tuple(exprs)):
            if node in hooks:
                continue
            if measure(node):
                path = node.args[0]
                a, b = (frame.vars.get(n.var) for n in path.path.nodes)
                if not isinstance(a, Node) or not isinstance(b, Node):
                    hooks[node] = lit(0) if path.every else Expr(F.lit(None).cast("long"), LONG)
                    continue
                frame, hooks[node] = paths.measured(self.graph, frame, a, b, path.path.rels[0], path.every)
            elif isinstance(node, A.ShortestPath):
                a, b = (frame.vars.get(n.var) for n in node.path.nodes)
                if not isinstance(a, Node) or not isinstance(b, Node):
                    hooks[node] = Expr(F.lit(None), NULL) if not node.every else Expr(F.array().cast("array<string>"), T.ArrayType(STRING))
                    continue
                frame, hooks[node] = paths.shortest(self.graph, frame, a, b, node.path.rels[0], node.every)
            elif isinstance(node, A.Call):
                args = [Compiler(frame.vars, hooks).compile(a) for a in node.args]
                frame, hooks[node] = analytics.call(self.graph, frame, node.name, args, None if self.writing else self.scores)
            else:
                frame, hooks[node] = self.pattern_value(frame, node)
        return frame, hooks

    def inner_pattern(self, frame: Frame, path: A.PathPattern, others: tuple, listed: bool):
        """The pattern's rows for the distinct outer values that it depends on, and the join condition back."""
        in_path = {n.var for n in path.nodes if n.var}
        shared = {v: b for v, b in frame.vars.items() if v in in_path and isinstance(b, Node)}
        if not shared:
            return None
        named = {x.name for o in (*others, tuple(n.props for n in path.nodes), tuple(r.props for r in path.rels)) for x in A.walk(o) if isinstance(x, A.Var)}
        outer = {v: b for v, b in frame.vars.items() if v in named and v not in in_path and v not in {r.var for r in path.rels}}
        conditions: list = []
        start = Frame(None, {})
        if outer or any(r.low is not None for r in path.rels):
            columns, variables = {}, {}
            for v, b in {**outer, **shared}.items():
                names = {c: fresh(v) for c in b.columns()}
                columns |= names
                variables[v] = _renamed(b, names)
            seeds = frame.df.select(*[F.col(c).alias(n) for c, n in columns.items()]).distinct()
            start = Frame(seeds, variables)
        inner = Matcher(self.graph, self.need).extend(start, path, conditions, {v: b.label for v, b in shared.items()})
        for c in conditions:
            inner = Frame(inner.df.where(c(inner)), inner.vars)
        if listed:
            for r in path.rels:
                b = inner.vars.get(r.var) if r.var else None
                if isinstance(b, Edge):
                    s = b.struct()
                    column = fresh(r.var)
                    inner = Frame(inner.df.withColumn(column, F.array(s.col)), {**inner.vars, r.var: Value(column, T.ArrayType(s.type))})
        keys = [inner.vars[v].key for v in shared]
        on = F.lit(True)
        for v, b in shared.items():
            on = on & same_node(b, inner.vars[v])
        if start.df is not None:
            for v, b in outer.items():
                for c, n in zip(b.columns(), start.vars[v].columns(), strict=True):
                    on = on & F.col(c).eqNullSafe(F.col(n))
                    keys.append(n)
        return inner, keys, on

    def pattern_value(self, frame: Frame, node) -> tuple[Frame, Expr]:
        where, body = getattr(node, "where", None), getattr(node, "body", None)
        got = self.inner_pattern(frame, node.path, (where, body), isinstance(node, A.PatternComprehension))
        column = fresh("pattern")
        if got is None:
            empty = {A.PatternComprehension: Expr(F.array().cast("array<string>"), T.ArrayType(STRING)), A.CountPattern: lit(0), A.PatternPredicate: lit(False)}[type(node)]
            return frame, empty
        inner, keys, on = got
        if where is not None:
            inner = self.filter(inner, where)
        if isinstance(node, A.PatternComprehension):
            inner, hooks = self.prepare(inner, (body,))
            e = Compiler(inner.vars, hooks).value(body)
            kind = STRING if is_null(e.type) else e.type
            rows = inner.df.groupBy(*keys).agg(F.collect_list(F.struct(convert(e, kind).alias("x"))).alias(column))
            value = Expr(F.coalesce(F.transform(F.col(column), lambda s: s.getField("x")), F.array().cast(T.ArrayType(kind))), T.ArrayType(kind))
        elif isinstance(node, A.CountPattern):
            rows = inner.df.groupBy(*keys).agg(F.count("*").alias(column))
            value = Expr(F.coalesce(F.col(column), F.lit(0)).cast("long"), LONG)
        else:
            rows = inner.df.select(*keys).distinct().withColumn(column, F.lit(True))
            value = Expr(F.coalesce(F.col(column), F.lit(False)), BOOL)
        return Frame(frame.df.join(rows, on, "left"), frame.vars), value

    def exists(self, frame: Frame, pattern: A.PatternComprehension, wanted: bool) -> Frame:
        got = self.inner_pattern(frame, pattern.path, (pattern.where,), True)
        if got is None:
            return Frame(frame.df.where(F.lit(not wanted)), frame.vars)
        inner, keys, on = got
        if pattern.where is not None:
            inner = self.filter(inner, pattern.where)
        return Frame(frame.df.join(inner.df.select(*dict.fromkeys(keys)), on, "left_semi" if wanted else "left_anti"), frame.vars)

    # ---- projections

    def project(self, frame: Frame, p: A.Projection, final: bool = False) -> Frame:
        items = [(name, A.Var(name)) for name in frame.vars] if p.star else []
        items += list(zip(default_names(p.items), [i.expr for i in p.items], strict=True))
        aggregated = any(has_aggregate(e) for _, e in items)
        order = [k for k in p.order]
        if aggregated:
            out, scope, hooks = self.aggregate(frame, items, order)
        else:
            frame, hooks = self.prepare(frame, [e for _, e in items] + [k.expr for k in order])
            out, scope = self.select(frame, items, hooks)
        if p.distinct:
            out = self.distinct(out)
            scope = out
        out = self.sorted(out, scope, hooks, items, order, p)
        if p.where is not None:
            out = self.filter(Frame(out.df, {n: out.vars[n] for n, _ in items}), p.where)
        return Frame(out.df, {n: out.vars[n] for n, _ in items})

    def select(self, frame: Frame, items, hooks) -> tuple[Frame, Frame]:
        """The items as new variables, and the scope of ORDER BY: these and the old ones."""
        compiler = Compiler(frame.vars, hooks)
        df, new = frame.df, {}
        columns = []
        for name, expr in items:
            if isinstance(expr, A.Var) and expr.name in frame.vars:
                new[name] = frame.vars[expr.name]
                continue
            e = compiler.compile(expr)
            if e.binding is not None:
                new[name] = e.binding
                continue
            column = fresh(name if name.isidentifier() else "value")
            columns.append(e.col.alias(column) if not is_null(e.type) else e.col.cast("string").alias(column))
            new[name] = Value(column, STRING if is_null(e.type) else e.type)
        if columns:
            df = df.select("*", *columns)
        return Frame(df, new), Frame(df, {**frame.vars, **new})

    def distinct(self, out: Frame) -> Frame:
        keys: list[str] = [self.rid] if self.rid else []
        carried: list[str] = []
        for b in out.vars.values():
            if isinstance(b, Value):
                keys.append(b.column)
            else:
                keys.append(b.key)
                carried += [c for c in b.columns() if c != b.key]
        keys = list(dict.fromkeys(keys))
        carried = [c for c in dict.fromkeys(carried) if c not in keys]
        if carried:
            df = out.df.groupBy(*keys).agg(*[F.first(c).alias(c) for c in carried])
        else:
            maps = [f.name for f in out.df.schema.fields if f.name in keys and isinstance(f.dataType, T.MapType)]
            df = out.df.select(*keys).distinct() if not maps else out.df.select(*keys).dropDuplicates([k for k in keys if k not in maps])
        return Frame(df, out.vars)

    def sorted(self, out: Frame, scope: Frame, hooks, items, order, p: A.Projection) -> Frame:
        names = {expr: name for name, expr in items}
        compiler = Compiler(scope.vars, hooks)
        keys = []
        for k in order:
            e = compiler.value(A.Var(names[k.expr])) if k.expr in names and names[k.expr] in out.vars else compiler.value(k.expr)
            keys += sort_columns(e, k.descending, k.nulls_first)
        df = out.df
        if self.rid:
            if p.skip or p.limit is not None:
                n = fresh("nth")
                df = df.withColumn(n, F.row_number().over(Window.partitionBy(self.rid).orderBy(*(keys or [F.lit(0)]))))
                low = p.skip or 0
                df = df.where((F.col(n) > low) & (F.col(n) <= low + p.limit if p.limit is not None else F.lit(True)))
            return Frame(df, out.vars)
        if keys:
            df = df.orderBy(*keys)
        if p.skip:
            df = df.offset(p.skip)
        if p.limit is not None:
            df = df.limit(p.limit)
        return Frame(df, out.vars)

    # ---- aggregation

    def aggregate(self, frame: Frame, items, order) -> tuple[Frame, Frame, dict]:
        found = [n for _, e in items for n in A.walk(e) if is_aggregate(n)]
        found += [n for k in order for n in A.walk(k.expr) if is_aggregate(n)]
        found = list(dict.fromkeys(found))
        inside = [a for n in found for a in (getattr(n, "args", ()) or ())] + [n for n in found if isinstance(n, A.CountPattern)]
        plain = [(n, e) for n, e in items if not has_aggregate(e)]
        frame, hooks = self.prepare(frame, [e for _, e in plain] + inside)
        compiler = Compiler(frame.vars, hooks)
        df = frame.df
        keys, carried, scope, key_hooks = ([self.rid] if self.rid else []), [], {}, {}
        new_columns = []

        def group(binding):
            keys.append(binding.key)
            carried.extend(c for c in binding.columns() if c != binding.key)

        for name, expr in plain:
            e = compiler.compile(expr)
            if e.binding is not None:
                group(e.binding)
                scope[name] = e.binding
                if isinstance(expr, A.Var):
                    scope.setdefault(expr.name, e.binding)
                continue
            if isinstance(expr, A.Var) and isinstance(frame.vars.get(expr.name), Value):
                scope[name] = frame.vars[expr.name]
                keys.append(scope[name].column)
                continue
            column = fresh(name if name.isidentifier() else "key")
            new_columns.append((e.col if not is_null(e.type) else e.col.cast("string")).alias(column))
            keys.append(column)
            scope[name] = Value(column, STRING if is_null(e.type) else e.type)
            key_hooks[expr] = scope[name].expr()
        # variables used beside aggregates are keys too
        beside = {v for _, e in items if has_aggregate(e) for v in _outside(e)}
        for v in sorted(beside):
            b = frame.vars.get(v)
            if b is None:
                continue
            if isinstance(b, Value):
                keys.append(b.column)
            else:
                group(b)
            scope.setdefault(v, b)
        if new_columns:
            df = df.select("*", *new_columns)
        aggregates, agg_hooks = [], {}
        for node in found:
            column = fresh("agg")
            col, kind, after = _aggregate(node, compiler, self.times)
            aggregates.append(col.alias(column))
            agg_hooks[node] = Expr(after(F.col(column)), kind)
        keys = list(dict.fromkeys(keys))
        carried = [c for c in dict.fromkeys(carried) if c not in keys]
        df = df.groupBy(*keys).agg(*aggregates, *[F.first(c).alias(c) for c in carried])
        hooks = {**key_hooks, **agg_hooks}
        scope_frame = Frame(df, scope)
        rest = [(n, e) for n, e in items if has_aggregate(e)]
        out, both = self.select(scope_frame, rest, hooks)
        variables = {n: (scope[n] if n in scope and not has_aggregate(e) else out.vars[n]) for n, e in items}
        return Frame(out.df, variables), Frame(out.df, {**scope, **variables}), hooks

    # ---- subqueries

    def call(self, frame: Frame, c: A.CallSubquery) -> Frame:
        parts = c.query.parts
        last = parts[-1].clauses[-1]
        if not isinstance(last, A.Return):
            inner = Frame(frame.df, frame.vars)
            for p in parts:
                for clause in p.clauses:
                    inner = self.clause(clause, inner)
            if not frame.vars:  # nothing outside: the rows inside are the result
                return inner
            return frame
        if len(parts) == 1 and self._plain(parts[0]):
            inner = frame
            for clause in parts[0].clauses[:-1]:
                inner = self.clause(self._imports(clause, frame), inner)
            out = self.project(inner, self._with_outer(last.projection, frame))
        else:
            out = self._numbered(frame, c.query)
        names = [n for n in out.vars if n not in frame.vars]
        if c.yields:
            missing = [y for y in c.yields if y not in out.vars]
            if missing:
                raise QueryError(f"the subquery doesn't return {missing[0]}")
            names = list(c.yields)
        out = Frame(out.df, {**frame.vars, **{n: out.vars[n] for n in names}})
        return self.filter(out, c.where) if c.where is not None else out

    @staticmethod
    def _plain(q: A.SingleQuery) -> bool:
        """Whether outer rows need no numbers: nothing inside looks at several rows at once."""
        for clause in q.clauses:
            if isinstance(clause, (A.With, A.Return)):
                p = clause.projection
                if p.distinct or p.limit is not None or p.skip or any(has_aggregate(i.expr) for i in p.items):
                    return False
            if isinstance(clause, (A.CallSubquery, *A.WRITES)):
                return False
        return True

    @staticmethod
    def _imports(clause, frame: Frame):
        """WITH inside a subquery keeps the outer variables."""
        if not isinstance(clause, A.With) or clause.projection.star:
            return clause
        return A.With(Planner._with_outer(clause.projection, frame))

    @staticmethod
    def _with_outer(p: A.Projection, frame: Frame) -> A.Projection:
        own = set(default_names(p.items))
        keep = tuple(A.Item(A.Var(v), v, v) for v in frame.vars if v not in own)
        return replace(p, items=keep + p.items, order=())

    def _read_only(self, frame: Frame) -> Frame:
        """The frame without properties that the query never reads: what is written out must not hold them."""
        if self.writing or ALL in self.need.get(ALL, ()):
            return frame
        variables, columns = {}, [self.rid] if self.rid else []
        for v, b in frame.vars.items():
            wanted = self.need.get(v, set())
            if isinstance(b, (Node, Edge)) and ALL not in wanted:
                b = replace(b, props={p: c for p, c in b.props.items() if p in wanted})
            variables[v] = b
            columns += b.columns()
        return Frame(frame.df.select(*dict.fromkeys(columns)), variables) if columns else frame

    def _numbered(self, frame: Frame, q: A.Query) -> Frame:
        """A subquery that aggregates, sorts or cuts: its outer rows are numbered, and it is planned for all at once."""
        frame = self._read_only(frame)
        rid, outer_rid = fresh("rid"), self.rid
        df = cut_lineage(frame.df.withColumn(rid, F.monotonically_increasing_id()))
        results, empties = [], []
        for p in q.parts:
            inner = Planner(self.graph, self.need)
            inner.rid = rid
            inner.writing = self.writing
            f = Frame(df, dict(frame.vars))
            for clause in p.clauses[:-1]:
                f = inner.clause(clause, f)
            last = p.clauses[-1].projection
            f = inner.project(f, last)
            self.graph = inner.graph
            results.append(Frame(f.df, {n: f.vars[n] for n in default_names(last.items)}) if not last.star else f)
            empties.append(all(has_aggregate(i.expr) for i in last.items) and not last.star and {n: i.expr for n, i in zip(default_names(last.items), last.items, strict=True)})
        self.rid = outer_rid
        if len(results) == 1:
            r, empty = results[0], empties[0]
        else:
            out = union([self._columns(r, rid, self._defaults(df, rid, e, r)) for r, e in zip(results, empties, strict=True)])
            if not all(q.all_flags):
                out = distinct(out)
            _, tail = self.without_tail(q)
            renamed = {n: fresh(n) for n in out.columns if n != rid}
            out = out.select(rid, *[F.col(f"`{n}`").alias(c) for n, c in renamed.items()])
            r, empty = Frame(out, {n: Value(c, out.schema[c].dataType) for n, c in renamed.items()}), False
            if tail is not None and (tail.order or tail.limit is not None or tail.skip):
                inner = Planner(self.graph, self.need)
                inner.rid = rid
                r = inner.sorted(r, r, {}, [], list(tail.order), tail)
        right = fresh("rid")
        own = {n: v for n, v in r.vars.items() if n not in frame.vars}
        columns = list(dict.fromkeys(c for v in own.values() for c in v.columns()))
        outer_columns = set(df.columns)
        fresh_names = {c: (fresh("in") if c in outer_columns else c) for c in columns}
        inner_df = r.df.select(F.col(rid).alias(right), *[F.col(c).alias(fresh_names[c]) for c in columns])
        own = {n: _renamed(v, fresh_names) for n, v in own.items()}
        joined = df.join(inner_df, F.col(rid) == F.col(right), "left" if empty else "inner")
        if empty:  # an aggregate over no rows still has a value
            for n, expr in empty.items():
                if n in own:
                    e = _empty_value(expr)
                    if not is_null(e.type):
                        joined = joined.withColumn(own[n].column, F.when(F.col(right).isNull(), convert(e, own[n].type)).otherwise(F.col(own[n].column)))
        return Frame(joined.drop(right, rid), {**frame.vars, **own})

    def _columns(self, r: Frame, rid: str, defaults) -> DataFrame:
        scope = Compiler(r.vars)
        cols = []
        for n in r.vars:
            e = scope.value(A.Var(n))
            cols.append((e.col.cast("string") if is_null(e.type) else e.col).alias(n))
        out = r.df.select(rid, *cols)
        return out if defaults is None else out.unionByName(defaults)

    def _defaults(self, df: DataFrame, rid: str, empty, r: Frame):
        if not empty:
            return None
        scope = Compiler(r.vars)
        lost = df.select(rid).join(r.df.select(rid), rid, "left_anti")
        return lost.select(rid, *[convert(_empty_value(e), scope.value(A.Var(n)).type).alias(n) for n, e in empty.items()])


def _renamed(b, names: dict):
    """A binding whose columns have other names."""
    if isinstance(b, Value):
        return Value(names[b.column], b.type)
    props = {p: (names.get(c, c), t) for p, (c, t) in b.props.items()}
    if isinstance(b, Node):
        return Node(names.get(b.key, b.key), b.space, b.label, names.get(b.labels, b.labels), props, b.loaded)
    return Edge(names.get(b.key, b.key), names.get(b.source, b.source), names.get(b.target, b.target), b.source_space, b.target_space, b.type, names.get(b.type_column, b.type_column), props)


def _outside(node):
    """Variables that an expression reads outside its aggregates."""
    if is_aggregate(node):
        return
    if isinstance(node, A.Var):
        yield node.name
    elif isinstance(node, tuple):
        for x in node:
            yield from _outside(x)
    elif hasattr(node, "__dataclass_fields__"):
        hidden = {getattr(node, f) for f in ("var", "acc") if hasattr(node, f)}
        for f in node.__dataclass_fields__:
            yield from (v for v in _outside(getattr(node, f)) if v not in hidden)


def _same(x):
    return x


def _aggregate(node, compiler: Compiler, times: str | None = None):
    """(aggregate column, type of its value, what to do with it afterwards); a row counts as many times as ``times`` says."""
    if isinstance(node, A.CountStar):
        return F.coalesce(F.sum(times), F.lit(0)).cast("long") if times else F.count(F.lit(1)), LONG, _same
    if isinstance(node, A.CountPattern):
        return F.coalesce(F.sum(compiler.compile(node).col), F.lit(0)).cast("long"), LONG, _same
    if len(node.args) != 1:
        raise QueryError(f"{node.name}() takes one argument")
    e = compiler.compile(node.args[0])
    if node.name == "count":
        col = e.binding.id() if e.binding is not None and node.distinct else e.col
        if times and not node.distinct:
            return F.coalesce(F.sum(F.when(col.isNotNull(), F.col(times))), F.lit(0)).cast("long"), LONG, _same
        return (F.count_distinct(col) if node.distinct else F.count(col)), LONG, _same
    e = compiler.plain(e)
    if node.name == "collect":
        kind = STRING if is_null(e.type) else e.type
        packed = F.collect_list(F.struct(convert(e, kind).alias("x")))

        def unpack(c):
            items = F.transform(c, lambda s: s.getField("x"))
            return F.array_distinct(items) if node.distinct else items

        return packed, T.ArrayType(kind), unpack
    if node.name in ("min", "max"):
        col = e.col.cast("string") if is_null(e.type) else e.col
        return (F.min(col) if node.name == "min" else F.max(col)), STRING if is_null(e.type) else e.type, _same
    x = e if is_number(e.type) else None
    if x is None:  # only numbers are summed
        return F.max(F.lit(0 if node.name == "sum" else None).cast("double")), DOUBLE, (lambda c: F.coalesce(c, F.lit(0.0))) if node.name == "sum" else _same
    if node.name == "sum":
        kind = LONG if is_integer(x.type) else DOUBLE
        col = (F.sum_distinct(x.col) if node.distinct else F.sum(x.col)).cast(kind)
        return F.coalesce(col, F.lit(0).cast(kind)), kind, _same
    return (F.sum_distinct(x.col) / F.count_distinct(x.col) if node.distinct else F.avg(x.col)).cast("double"), DOUBLE, _same


def _empty_value(expr) -> Expr:
    """The value of an aggregating expression over no rows."""
    hooks = {}
    for n in A.walk(expr):
        if isinstance(n, (A.CountStar, A.CountPattern)) or (isinstance(n, A.Call) and n.name in ("count", "sum")):
            hooks[n] = lit(0)
        elif is_aggregate(n):
            hooks[n] = Expr(F.array().cast("array<string>"), T.ArrayType(NULL)) if n.name == "collect" else Expr(F.lit(None), NULL)
    return Compiler({}, hooks).value(expr)


def union(frames: list[DataFrame]) -> DataFrame:
    """All rows, columns aligned by name in order of first appearance, missing ones null."""
    kinds: dict[str, list] = {}
    for f in frames:
        for c in f.schema.fields:
            kinds.setdefault(c.name, []).append(c.dataType)
    to = {n: common(ts) for n, ts in kinds.items()}
    out = None
    for f in frames:
        own = {c.name: c.dataType for c in f.schema.fields}
        one = f.select(*[(convert(Expr(F.col(f"`{n}`"), own[n]), t) if n in own else F.lit(None).cast(t)).alias(n) for n, t in to.items()])
        out = one if out is None else out.unionByName(one)
    return out


def distinct(df: DataFrame) -> DataFrame:
    maps = [f.name for f in df.schema.fields if isinstance(f.dataType, T.MapType)]
    if not maps:
        return df.distinct()
    keyed = df.select("*", *[F.array_sort(F.map_entries(m)).alias(f"__{m}") for m in maps])
    return keyed.dropDuplicates([c for c in keyed.columns if c not in maps]).drop(*[f"__{m}" for m in maps])


__all__ = ["Planner", "number", "run"]
