"""Plans of patterns: left-deep joins of node scans and adjacency.

A typed hop joins the stored keys of one edge table.  A node's own table joins only if its labels are not
implied by the edge table, or one of its properties is read.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import ast as A
from ..errors import QueryError
from ..functions.typed import LONG, STRING, Expr, common, convert
from ..graph import EdgeTable, NodeTable, PropertyGraph, edge_id, space_id, undirected
from .bindings import Edge, Frame, Node, Value, fresh
from .expressions import Compiler, label_test, same_node
from .needs import ALL


def types_of(df: DataFrame) -> dict[str, T.DataType]:
    return {f.name: f.dataType for f in df.schema.fields}


def scan_nodes(graph: PropertyGraph, labels: A.LabelTerm | None, hint: str | None = None) -> tuple[DataFrame, Node]:
    """Nodes with the labels, under fresh column names."""
    tables = [t for t in graph.nodes if t.label is None or ((labels is None or labels.accepts({t.label})) and (hint is None or t.label == hint))]
    if len(tables) == 1 and tables[0].label:
        return scan_table(tables[0])
    some = replace(graph, nodes=tuple(tables))
    df = some.node_frame()
    if labels is not None and any(t.label is None for t in tables):
        df = df.where(label_test(F.col("labels"), labels))
    kinds = types_of(df)
    key, own = fresh("n"), fresh("labels")
    props = {c: (fresh(c), kinds[c]) for c in df.columns if c not in ("id", "labels")}
    df = df.select(F.col("id").alias(key), F.col("labels").alias(own), *[F.col(f"`{c}`").alias(a) for c, (a, _) in props.items()])
    return df, Node(key, None, None, own, props)


def scan_table(t: NodeTable) -> tuple[DataFrame, Node]:
    kinds = types_of(t.df)
    key = fresh(t.label)
    props = {p: (fresh(p), kinds[c]) for p, c in t.props.items()}
    df = t.df.select(F.col(t.key).alias(key), *[F.col(f"`{c}`").alias(props[p][0]) for p, c in t.props.items()])
    return df, Node(key, t.label, t.label, None, props)


@dataclass(frozen=True)
class Hops:
    """Oriented edges: rows from one end to the other."""

    df: DataFrame
    edge: Edge
    start: Node  # keys only
    end: Node


def accepts(label: str | None, term: A.LabelTerm | None, hint: str | None) -> bool:
    return label is None or ((term is None or term.accepts({label})) and (hint is None or hint == label))


def oriented(graph: PropertyGraph, rel: A.RelPattern, left=(None, None), right=(None, None)) -> list[tuple[EdgeTable, bool]]:
    """Edge tables that a hop can follow, and whether against their direction."""
    found = []
    for t in graph.edges:
        if rel.types and t.type is not None and t.type not in rel.types:
            continue
        mixed = t.undirected or t.undirected_column is not None
        for back in (False, True):
            wanted = {"OUT": not back or mixed, "IN": back or mixed, "BOTH": True}[rel.direction]
            a, b = (t.target_label, t.source_label) if back else (t.source_label, t.target_label)
            if wanted and accepts(a, *left) and accepts(b, *right):
                found.append((t, back))
    return found


def hops(graph: PropertyGraph, rel: A.RelPattern, left=(None, None), right=(None, None), generic: bool = False) -> Hops:
    """Edges of the pattern's types as seen from its left end.

    ``left`` and ``right`` are (label term, known label) of the ends: edge tables and orientations that can't
    join are left out.  One typed orientation keeps stored keys; several become one generic table.
    """
    found = oriented(graph, rel, left, right)
    parts = [_oriented(graph, t, back, rel, len(found) > 1 or generic) for t, back in found]
    if len(parts) == 1:
        return parts[0]
    return _merged(graph, parts)


def _held(graph: PropertyGraph, t: EdgeTable, column: str, label: str | None) -> NodeTable | None:
    """The node table whose rows the edge table's rows are, at the end with that key column.

    A foreign key's own table is such an edge table: its rows hold the properties of one end, so that end needs
    no join.
    """
    return next((n for n in graph.nodes if n.label is not None and n.label == label and n.df is t.df and n.key == column), None)


def _rows(t: EdgeTable, back: bool, rel: A.RelPattern) -> DataFrame:
    """The rows of an edge table that a hop follows in one orientation."""
    df = t.df
    if t.type is None and rel.types:
        df = df.where(F.col(t.type_column).isin(*rel.types))
    natural = {"OUT": False, "IN": True}.get(rel.direction)
    if natural is not None and back != natural:  # the other way only along undirected edges
        df = df.where(undirected(t) & (F.col(t.source) != F.col(t.target)))
    elif rel.direction == "BOTH" and back and t.source_label == t.target_label:
        df = df.where(F.col(t.source) != F.col(t.target))
    return df


def bare_hops(graph: PropertyGraph, rel: A.RelPattern, left=(None, None), right=(None, None)) -> DataFrame:
    """(a, b): the string ids of both ends of every hop, and nothing else of it."""
    out = None
    for t, back in oriented(graph, rel, left, right):
        one = bare_hop(t, back, rel)
        out = one if out is None else out.unionByName(one)
    return graph.spark.createDataFrame([], "a string, b string") if out is None else out


def bare_hop(t: EdgeTable, back: bool, rel: A.RelPattern) -> DataFrame:
    """(a, b) of the hops along one edge table."""
    ends = [space_id(t.source_label, F.col(t.source)), space_id(t.target_label, F.col(t.target))]
    a, b = ends[::-1] if back else ends
    return _rows(t, back, rel).select(a.alias("a"), b.alias("b"))


def bare_steps(graph: PropertyGraph, rel: A.RelPattern, live: DataFrame, left=(None, None)) -> DataFrame:
    """The rows of ``live`` with ``node``, a string id, moved along every hop that leads to another node.

    ``live`` is broadcast to the edges, which are met by their stored keys: ids are only made of hops that are taken.
    """
    out = None
    for t, back in oriented(graph, rel, left):
        (a, space), (b, to) = ((t.source, t.source_label), (t.target, t.target_label))[:: -1 if back else 1]
        kind, held = types_of(t.df)[a], live.withColumn("key", F.col("node"))
        if space is not None:
            rest = F.substring("node", len(space) + 2, 2**31 - 1)
            # a key that another text stands for is another node's
            held = live.where(F.startswith("node", F.lit(f"{space}:"))).withColumn("key", rest.try_cast(kind)).where(F.col("key").cast("string") == rest)
        one = _rows(t, back, rel).select(F.col(a).alias("a"), F.col(b).alias("b")).join(F.broadcast(held), F.col("a") == F.col("key"))
        one = one.withColumn("b", space_id(to, F.col("b"))).where("node <> b").select(*[F.col("b" if c == "node" else c).alias(c) for c in live.columns])
        out = one if out is None else out.unionByName(one)
    return live.limit(0) if out is None else out


def _oriented(graph: PropertyGraph, t: EdgeTable, back: bool, rel: A.RelPattern, as_text: bool) -> Hops:
    df, kinds = _rows(t, back, rel), types_of(t.df)
    eid, s, d, ty = fresh("e"), fresh("src"), fresh("dst"), fresh("type")
    spaces = (None, None) if as_text else (t.source_label, t.target_label)
    ends = [space_id(label, F.col(c)) if as_text else F.col(c) for label, c in ((t.source_label, t.source), (t.target_label, t.target))]
    props = {p: (fresh(p), kinds[c]) for p, c in t.props.items() if p != "type" or t.type}
    kind = F.lit(t.type) if t.type else F.col(t.type_column)
    cols, nodes = [], []
    for c, sp, label, own in ((s, spaces[0], t.source_label, t.source), (d, spaces[1], t.target_label, t.target)):
        table = None if as_text else _held(graph, t, own, label)
        held = {p: (fresh(p), kinds[k]) for p, k in table.props.items()} if table else {}
        cols += [F.col(f"`{table.props[p]}`").alias(a) for p, (a, _) in held.items()]
        nodes.append(Node(c, sp, label if not as_text else None, None, held, bool(table)))
    df = df.select(edge_id(t).alias(eid), ends[0].alias(s), ends[1].alias(d), kind.cast("string").alias(ty), *[F.col(f"`{t.props[p]}`").alias(a) for p, (a, _) in props.items()], *cols)
    edge = Edge(eid, s, d, spaces[0], spaces[1], t.type, ty, props)
    start, end = nodes[::-1] if back else nodes
    return Hops(df, edge, start, end)


def _merged(graph: PropertyGraph, parts: list[Hops]) -> Hops:
    """Several oriented tables as one, with string ids and all properties."""
    kinds: dict[str, list] = {}
    for h in parts:
        for p, (_, t) in h.edge.props.items():
            kinds.setdefault(p, []).append(t)
    eid, s, d, a, b, ty = (fresh(x) for x in ("e", "src", "dst", "from", "to", "type"))
    props = {p: (fresh(p), common(ts)) for p, ts in kinds.items()}
    out = None
    for h in parts:
        cols = [F.col(h.edge.key).alias(eid), F.col(h.edge.source).alias(s), F.col(h.edge.target).alias(d), F.col(h.start.key).alias(a), F.col(h.end.key).alias(b), h.edge.type_of().alias(ty)]
        for p, (name, kind) in props.items():
            own = h.edge.props.get(p)
            cols.append((convert(Expr(F.col(own[0]), own[1]), kind) if own else F.lit(None).cast(kind)).alias(name))
        one = h.df.select(*cols)
        out = one if out is None else out.unionByName(one)
    if out is None:
        names = [eid, s, d, a, b, ty]
        out = graph.spark.createDataFrame([], ", ".join(f"`{n}` string" for n in names))
    edge = Edge(eid, s, d, None, None, None, ty, props)
    return Hops(out, edge, Node(a, None, loaded=False), Node(b, None, loaded=False))


def _named(paths: tuple) -> set:
    return {x.var for p in paths for x in (p, *p.nodes, *p.rels) if x.var}


def flip(rel: A.RelPattern) -> A.RelPattern:
    return replace(rel, direction={"OUT": "IN", "IN": "OUT", "BOTH": "BOTH"}[rel.direction])


class Matcher:
    """Extends a frame by the patterns of one MATCH.

    ``counted`` says that of a variable-length hop only the number of its paths is asked for.  Where that needs no path, a
    row stands for as many as its column ``times`` says, and the relationship and the far end are that number.
    """

    def __init__(self, graph: PropertyGraph, need: dict[str, set], counted: bool = False):
        self.graph, self.need, self.counted = graph, need, counted
        self.times: str | None = None

    def reads(self, var: str | None) -> bool:
        """Whether a property, a label or the whole of the variable is read."""
        if var is None:
            return False
        if ALL in self.need.get(ALL, ()):
            return True
        return bool(self.need.get(var, set()) - {"id"})

    def whole(self, var: str | None) -> bool:
        return var is not None and (ALL in self.need.get(var, ()) or ALL in self.need.get(ALL, ()))

    # ---- MATCH

    def match(self, frame: Frame, m: A.Match, hooked) -> Frame:
        """Inner match: rows of the frame extended by every occurrence of the patterns."""
        conditions: list = []
        names = set(frame.vars)
        for path in self._around(frame, m.paths):
            frame = self.extend(frame, path, conditions)
        frame = replace(frame, vars={v: b for v, b in frame.vars.items() if v in names or v in _named(m.paths)})
        for c in conditions:
            frame = Frame(frame.df.where(c(frame)), frame.vars)
        if m.where is not None:
            frame = hooked(frame, m.where)
        return frame

    def _around(self, frame: Frame, paths: tuple) -> tuple:
        """The paths, or if they close a circle their hops in an order that keeps the rows between few.

        Hops that close a circle come first, then those to at most one node (the end's own table holds them), then
        others.  Of all hops to start from, the one that leaves fewest of the last kind is taken.
        """
        if any(p.var or any(r.low is not None for r in p.rels) for p in paths):
            return paths
        written, paths = paths, tuple(replace(p, nodes=tuple(n if n.var else replace(n, var=fresh("any")) for n in p.nodes)) for p in paths)
        labels: dict = {}
        for n in (n for p in paths for n in p.nodes):
            labels[n.var] = labels.get(n.var) or n.labels
        every = [(p, i) for p in paths for i in range(len(p.rels))]
        joined = {v: v for v in labels}  # the nodes that hops connect, as trees

        def root(v):
            return v if joined[v] == v else root(joined[v])

        circle = False
        for p, i in every:
            a, b = root(p.nodes[i].var), root(p.nodes[i + 1].var)
            circle = circle or a == b
            joined[a] = b
        if not circle:
            return written
        start = frozenset(v for v in labels if v in frame.vars)

        def rank(hop, known):
            p, i = hop
            a, b = p.nodes[i], p.nodes[i + 1]
            if a.var in known and b.var in known:
                return 0
            if a.var not in known and b.var not in known:
                return 3
            own = {n.var: x.label if isinstance(x := frame.vars.get(n.var), Node) else None for n in (a, b)}
            found = oriented(self.graph, p.rels[i], *[(labels[n.var], own[n.var]) for n in (a, b)])
            if len(found) != 1:
                return 2
            t, back = found[0]
            column, label = (t.source, t.source_label) if (a.var in known) != back else (t.target, t.target_label)
            return 1 if _held(self.graph, t, column, label) else 2

        def order(first):
            left, known, out, cost = list(every), start, [], [0, 0, 0, 0]
            while left:
                hop = first if first is not None and not out else min(left, key=lambda h: rank(h, known))
                if out or first is None:
                    cost[rank(hop, known)] += 1
                left.remove(hop)
                out.append(hop)
                known = known | {n.var for n in hop[0].nodes[hop[1] : hop[1] + 2]}
            return (cost[3], cost[2]), out

        _, best = min((order(h) for h in ([None] if start else every)), key=lambda x: x[0])
        out = [replace(p, nodes=tuple(replace(n, labels=n.labels or labels[n.var]) for n in p.nodes[i : i + 2]), rels=(p.rels[i],)) for p, i in best]
        return (*out, *(p for p in paths if not p.rels))

    def optional(self, frame: Frame, m: A.Match, condition) -> Frame:
        """Left outer match: the WHERE belongs to the join, and rows without a match keep nulls."""
        names = {x.var for p in m.paths for x in p.nodes if x.var}
        shared = {v: b for v, b in frame.vars.items() if v in names and isinstance(b, Node)}
        varying = any(r.low is not None for p in m.paths for r in p.rels)
        inner = Frame(None, {})
        if varying and shared:  # paths are only followed from nodes that the frame has
            for v, b in shared.items():
                key = fresh("seed")
                seeds = frame.df.select(F.col(b.key).alias(key)).where(F.col(key).isNotNull()).distinct()
                inner = self._cross(inner, seeds, **{v: Node(key, b.space, b.label, None, {}, False)})
        conditions: list = []
        hints = {v: b.label for v, b in shared.items()}
        edges = {v: b for v, b in frame.vars.items() if isinstance(b, (Edge, Value))}
        for path in m.paths:
            inner = self.extend(inner, path, conditions, hints)
        on = F.lit(True)
        for v, b in shared.items():
            on = on & same_node(b, inner.vars[v])
        for v, b in edges.items():
            if v in inner.vars and isinstance(b, Edge) and isinstance(inner.vars[v], Edge):
                on = on & (b.id() == inner.vars[v].id())
        merged = {**inner.vars, **frame.vars}
        for c in conditions:
            on = on & c(Frame(None, merged))
        if m.where is not None:
            on = on & condition(Frame(None, merged), m.where)
        df = frame.df.join(inner.df, on, "left")
        for v, b in inner.vars.items():  # a variable-length relationship that is not there is an empty list
            if v not in frame.vars and isinstance(b, Value) and isinstance(b.type, T.ArrayType):
                df = df.withColumn(b.column, F.coalesce(F.col(b.column), F.array().cast(b.type)))
        return Frame(df, merged)

    def _cross(self, frame: Frame, df: DataFrame, **more) -> Frame:
        if frame.df is None:
            return Frame(df, {**frame.vars, **more})
        return Frame(frame.df.crossJoin(df), {**frame.vars, **more}, (frame, Frame(df, more)))

    # ---- one path

    def extend(self, frame: Frame, path: A.PathPattern, conditions: list, hints: dict | None = None) -> Frame:
        hints = hints or {}
        nodes = list(path.nodes)
        at = next((i for i, n in enumerate(nodes) if n.var in frame.vars and n.var), 0)
        bound: dict[int, Node] = {}
        edges: dict[int, Edge | Value] = {}
        inner: dict[int, str | None] = {}
        n = nodes[at]
        if n.var and n.var in frame.vars:
            bound[at] = self._known(frame, n, conditions)
        elif at == 0 and path.rels and path.rels[0].low is None and (not self._needs_table(n, path) or self._starts_held(path, hints)):
            frame, bound[0], edges[0], bound[1] = self._first(frame, path, hints, conditions)
            self._props(n, bound[0], conditions)
        else:
            df, node = scan_nodes(self.graph, n.labels, hints.get(n.var))
            frame = self._cross(frame, df)
            bound[at] = node
            self._props(n, node, conditions)
        if n.var:
            frame = replace(frame, vars={**frame.vars, n.var: bound[at]})
        if 1 in bound and 0 in edges:
            frame = self._bind_rel(frame, path.rels[0], edges[0])
            frame = self._settle(frame, nodes[1], bound, 1, path, conditions)
        for i in range(at, len(path.rels)):
            if i not in edges:
                frame = self._hop(frame, path, i, bound, edges, inner, path.rels[i], i, i + 1, conditions, hints)
        for i in range(at - 1, -1, -1):
            frame = self._hop(frame, path, i, bound, edges, inner, flip(path.rels[i]), i + 1, i, conditions, hints)
        if path.var:
            frame = self._path_value(frame, path, bound, edges, inner)
        return frame

    def _needs_table(self, n: A.NodePattern, path: A.PathPattern) -> bool:
        return bool(n.props) or self.reads(n.var) or path.var is not None

    def _starts_held(self, path: A.PathPattern, hints) -> bool:
        """Whether the first hop's edge table holds the first node's properties."""
        a, b, rel = path.nodes[0], path.nodes[1], path.rels[0]
        found = oriented(self.graph, rel, (a.labels, hints.get(a.var)), (b.labels, hints.get(b.var)))
        if len(found) != 1:
            return False
        t, back = found[0]
        return _held(self.graph, t, t.target if back else t.source, t.target_label if back else t.source_label) is not None

    def _known(self, frame: Frame, n: A.NodePattern, conditions: list) -> Node:
        b = frame.vars[n.var]
        if isinstance(b, Value):  # a node that came through a list or a map
            e = b.expr()
            if not isinstance(e.type, T.StructType):
                raise QueryError(f"{n.var} is no node")
            raise QueryError(f"{n.var} is a value; patterns start at nodes bound by MATCH")
        if n.labels is not None:
            if b.label:
                if not n.labels.accepts({b.label}):
                    conditions.append(lambda f: F.lit(False))
            else:
                conditions.append(lambda f, b=b, t=n.labels: label_test(b.labels_column(), t))
        self._props(n, b, conditions)
        return b

    def _props(self, n, b, conditions: list):
        for key, expr in n.props:
            def holds(frame, key=key, expr=expr, b=b):
                var = fresh("x")
                return Compiler({**frame.vars, var: b}).keeps(A.Binary("=", A.Prop(A.Var(var), key), expr))

            conditions.append(holds)

    def _label_known(self, n: A.NodePattern, b: Node) -> bool:
        return n.labels is None or (b.label is not None and n.labels.accepts({b.label}))

    def _first(self, frame: Frame, path: A.PathPattern, hints, conditions):
        """Start from the edges themselves: the first node's table is not needed."""
        a, b, rel = path.nodes[0], path.nodes[1], path.rels[0]
        h = hops(self.graph, rel, (a.labels, hints.get(a.var)), (b.labels, hints.get(b.var)))
        frame = self._cross(frame, h.df)
        start = h.start
        if not self._label_known(a, start):
            df, node = scan_nodes(self.graph, a.labels, hints.get(a.var))
            frame = Frame(frame.df.join(df, same_node(start, node)), frame.vars)
            start = node
        self._props(rel, h.edge, conditions)
        return frame, start, h.edge, h.end

    def _bind_rel(self, frame: Frame, rel: A.RelPattern, edge) -> Frame:
        if not rel.var:
            return frame
        old = frame.vars.get(rel.var)
        if isinstance(old, Edge):
            return Frame(frame.df.where(old.id() == edge.id()), frame.vars)
        return Frame(frame.df, {**frame.vars, rel.var: edge})

    def _settle(self, frame: Frame, n: A.NodePattern, bound: dict, i: int, path: A.PathPattern, conditions: list, hint=None) -> Frame:
        """Join a hop's end with its table, or with the variable that it is already."""
        end = bound[i]
        if n.var and n.var in frame.vars:
            known = self._known(frame, n, conditions)
            bound[i] = known
            return Frame(frame.df.where(same_node(known, end)), frame.vars)
        if not self._label_known(n, end) or (not end.loaded and self._needs_table(n, path)):
            df, node = scan_nodes(self.graph, n.labels, hint or end.label)
            frame = Frame(frame.df.join(df, same_node(end, node)), frame.vars)
            end = node
        self._props(n, end, conditions)
        bound[i] = end
        if n.var:
            frame = Frame(frame.df, {**frame.vars, n.var: end})
        return frame

    def _hop(self, frame, path, i, bound, edges, inner, rel, a, b, conditions, hints) -> Frame:
        left, right = path.nodes[a], path.nodes[b]
        known = frame.vars.get(right.var) if right.var else None
        to_label = known.label if isinstance(known, Node) else hints.get(right.var)
        if rel.low is not None:
            from ..operators.paths import count_paths, expand

            if self.counted and (got := count_paths(self.graph, frame.df, bound[a], rel, (right.labels, to_label))):
                df, self.times = got
                return Frame(df, {**frame.vars, **{x.var: Value(self.times, LONG) for x in (rel, right) if x.var}})
            alone = set(frame.df.columns) == set(bound[a].columns())
            frame, edges[i], bound[b], inner[i] = expand(self, frame, bound[a], rel, path, a > b, (right.labels, to_label), alone)
            frame = self._bind_rel(frame, rel, edges[i])
            return self._settle(frame, right, bound, b, path, conditions, hints.get(right.var))
        h = hops(self.graph, rel, (left.labels, bound[a].label), (right.labels, to_label))
        on = same_node(bound[a], h.start)
        if isinstance(known, Node):
            on = on & same_node(known, h.end)
        frame = Frame(frame.df.join(h.df, on), frame.vars)
        edges[i] = h.edge
        bound[b] = h.end
        self._props(rel, h.edge, conditions)
        frame = self._bind_rel(frame, rel, h.edge)
        return self._settle(frame, right, bound, b, path, conditions, hints.get(right.var))

    def _path_value(self, frame: Frame, path: A.PathPattern, bound, edges, inner) -> Frame:
        """The struct of all nodes and all relationships in path order."""
        nodes: list[Expr] = []
        rels: list[Expr] = []
        for i in range(len(path.nodes)):
            one = bound[i].struct()
            nodes.append(Expr(F.array(one.col), T.ArrayType(one.type)))
            if i < len(path.rels):
                e = edges[i]
                if isinstance(e, Value):
                    rels.append(e.expr())
                    if inner.get(i):
                        nodes.append(inner[i])
                else:
                    one = e.struct()
                    rels.append(Expr(F.array(one.col), T.ArrayType(one.type)))
        cols, kinds = [], []
        for group in (nodes, rels):
            kind = common([g.type for g in group]) if group else T.ArrayType(T.StructType([T.StructField("id", STRING)]))
            cols.append(F.concat(*[convert(g, kind) for g in group]) if group else F.array().cast(kind))
            kinds.append(kind)
        whole = F.struct(cols[0].alias("nodes"), cols[1].alias("relationships"))
        column = fresh(path.var)
        kind = T.StructType([T.StructField("nodes", kinds[0]), T.StructField("relationships", kinds[1])])
        return Frame(frame.df.withColumn(column, whole), {**frame.vars, path.var: Value(column, kind)})


def where_of(frame: Frame, node, hooks=None) -> Column:
    return Compiler(frame.vars, hooks).condition(node)
