"""Writes: every write clause gives new versions of the graph's node and edge tables.

New rows are checkpointed before they are used, because the ids made for them must not change when a plan is
run again.  Variables bound before a write see its effect.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import ast as A
from ..errors import QueryError
from ..functions.typed import STRING, Expr, as_list, common, convert, is_null
from ..graph import _union
from ..plans.bindings import Edge, Frame, Node, Value, fresh
from ..plans.expressions import Compiler, same_node
from ..plans.match import Matcher, hops, scan_nodes
from .cutting import cut_lineage


def write(planner, frame: Frame, clause) -> Frame:
    frame = Frame(cut_lineage(frame.df), frame.vars)
    if isinstance(clause, A.Create):
        for path in clause.paths:
            frame = create(planner, frame, path)
        return frame
    if isinstance(clause, A.SetClause):
        return set_values(planner, frame, clause.items)
    if isinstance(clause, A.Remove):
        return set_values(planner, frame, clause.items, remove=True)
    if isinstance(clause, A.Delete):
        return delete(planner, frame, clause)
    if isinstance(clause, A.Merge):
        return merge(planner, frame, clause)
    return foreach(planner, frame, clause)


def _update(planner, nodes: DataFrame | None = None, edges: DataFrame | None = None) -> None:
    g = planner.graph
    planner.graph = g.with_frames(cut_lineage(nodes) if nodes is not None else g.nodes[0].df, cut_lineage(edges) if edges is not None else g.edges[0].df)


def refreshed(planner, frame: Frame) -> Frame:
    """The frame with nodes and relationships as they are now; those deleted become null."""
    df, variables = frame.df, dict(frame.vars)
    for name, b in frame.vars.items():
        if isinstance(b, Node):
            rows, new = scan_nodes(planner.graph, None)
            df = df.join(rows, b.id() == F.col(new.key), "left")
            variables[name] = new
        elif isinstance(b, Edge):
            h = hops(planner.graph, A.RelPattern(None, (), (), "OUT"), generic=True)
            rows = h.df.where(F.col(h.start.key) == F.col(h.edge.source))
            df = df.join(rows, b.id() == F.col(h.edge.key), "left")
            variables[name] = h.edge
    return Frame(cut_lineage(df), variables)


# ---- create


def _labels(planner, n: A.NodePattern) -> list[str]:
    if n.labels is None:
        return []
    if len(n.labels.any_of) != 1 or any(negated for _, negated in n.labels.any_of[0]):
        raise QueryError("new nodes take plain labels")
    return [name for name, _ in n.labels.any_of[0]]


def _props(frame: Frame, props) -> list[tuple[str, Expr]]:
    got = [(k, Compiler(frame.vars).value(e)) for k, e in props]
    return [(k, Expr(e.col.cast("string"), STRING) if is_null(e.type) else e) for k, e in got]


def create(planner, frame: Frame, path: A.PathPattern) -> Frame:
    """One new node for each unbound node of the pattern and one new edge for each relationship, per row."""
    df, ids = frame.df, []
    for n in path.nodes:
        key = fresh("new")
        known = frame.vars.get(n.var) if n.var else None
        repeated = next((ids[i] for i, m in enumerate(path.nodes[: len(ids)]) if n.var and m.var == n.var), None)
        if repeated:
            ids.append(repeated)
            continue
        df = df.withColumn(key, known.id() if isinstance(known, Node) else F.uuid())
        ids.append(key)
    rel_ids = [fresh("edge") for _ in path.rels]
    for key in rel_ids:
        df = df.withColumn(key, F.uuid())
    df = cut_lineage(df)
    made = Frame(df, frame.vars)
    seen: set = set()
    node_rows, edge_rows = [], []
    label = planner.graph.config.label_property
    for n, key in zip(path.nodes, ids, strict=True):
        if (n.var and n.var in frame.vars) or key in seen:
            continue
        seen.add(key)
        labels = _labels(planner, n)
        cols = [F.col(key).alias("id"), F.array(*[F.lit(x) for x in labels]).cast("array<string>").alias("labels")]
        cols += [e.col.alias(k) for k, e in _props(made, n.props)]
        if label in planner.graph.nodes[0].props and labels and label not in dict(n.props):
            kind = planner.graph.nodes[0].df.schema[label].dataType
            cols.append((F.array(*[F.lit(x) for x in labels]) if isinstance(kind, T.ArrayType) else F.lit(labels[0])).alias(label))
        node_rows.append(df.select(*cols))
    for i, (r, key) in enumerate(zip(path.rels, rel_ids, strict=True)):
        a, b = (ids[i + 1], ids[i]) if r.direction == "IN" else (ids[i], ids[i + 1])
        kind = F.lit(r.types[0]) if r.types else F.lit(None).cast("string")
        edge_rows.append(df.select(F.col(key).alias("id"), F.col(a).alias("source"), F.col(b).alias("target"), kind.alias("type"), F.lit(False).alias("undirected"), *[e.col.alias(k) for k, e in _props(made, r.props)]))
    g = planner.graph
    _update(planner, _union([g.nodes[0].df, *node_rows]) if node_rows else None, _union([g.edges[0].df, *edge_rows]) if edge_rows else None)
    variables = dict(frame.vars)
    for n, key in zip(path.nodes, ids, strict=True):
        if n.var and n.var not in frame.vars:
            variables[n.var] = Node(key, None, loaded=False)
    for r, key in zip(path.rels, rel_ids, strict=True):
        if r.var:
            variables[r.var] = Edge(key, key, key, None, None)
    out = refreshed(planner, Frame(df, variables))
    return out


# ---- set, remove


def set_values(planner, frame: Frame, items, remove: bool = False) -> Frame:
    """New values of properties and labels; of several rows for one entity the first wins.

    Items are taken in turn, and each sees what those before it have set.
    """
    for item in items:
        target = item.target
        var = target.base.name if isinstance(target, A.Prop) else target.name
        b = frame.vars.get(var)
        if b is None:
            raise QueryError(f"unknown variable {var}")
        if not isinstance(b, (Node, Edge)):
            raise QueryError(f"{var} is neither a node nor a relationship")
        is_node = isinstance(b, Node)
        base = planner.graph.nodes[0].df if is_node else planner.graph.edges[0].df
        hit = fresh("hit")
        if isinstance(target, A.Prop):
            value = Expr(F.lit(None).cast("string"), STRING) if remove else Compiler(frame.vars).value(item.value)
            old = {f.name: f.dataType for f in base.schema.fields}.get(target.key)
            kind = old if old is not None and (remove or is_null(value.type)) else common([value.type, old or T.NullType()])
            kind = STRING if is_null(kind) else kind
            rows = frame.df.select(b.id().alias("__id"), convert(value, kind).alias("__v")).where("__id is not null")
            rows = rows.groupBy("__id").agg(F.first("__v").alias("__v"), F.lit(True).alias(hit))
            joined = base.join(rows, F.col("id") == F.col("__id"), "left")
            before = convert(Expr(F.col(target.key), old), kind) if old is not None else F.lit(None).cast(kind)
            new = joined.withColumn(target.key, F.when(F.col(hit), F.col("__v")).otherwise(before)).drop("__id", "__v", hit)
        else:
            if not is_node:
                raise QueryError("relationships have no labels")
            rows = frame.df.select(b.id().alias("__id")).where("__id is not null").distinct().withColumn(hit, F.lit(True))
            joined = base.join(rows, F.col("id") == F.col("__id"), "left")
            names = F.array(*[F.lit(x) for x in item.labels])
            changed = F.array_except("labels", names) if remove else F.array_union("labels", names)
            new = joined.withColumn("labels", F.when(F.col(hit), changed).otherwise(F.col("labels"))).drop("__id", hit)
        _update(planner, new if is_node else None, None if is_node else new)
        frame = refreshed(planner, frame)
    return frame


# ---- delete


def delete(planner, frame: Frame, clause: A.Delete) -> Frame:
    """Nodes go with their edges; edges, lists of them and paths go too."""
    node_ids, edge_ids = [], []
    for expr in clause.exprs:
        e = Compiler(frame.vars).compile(expr)
        if isinstance(e.binding, Node):
            node_ids.append(frame.df.select(e.binding.id().alias("x")))
        elif isinstance(e.binding, Edge):
            edge_ids.append(frame.df.select(e.binding.id().alias("x")))
        elif isinstance(e.type, T.ArrayType) and isinstance(e.type.elementType, T.StructType):
            into = edge_ids if "source" in e.type.elementType.fieldNames() else node_ids
            into.append(frame.df.select(F.explode(F.transform(e.col, lambda s: s.getField("id"))).alias("x")))
        elif isinstance(e.type, T.StructType) and "id" in e.type.fieldNames():
            into = edge_ids if "source" in e.type.fieldNames() else node_ids
            into.append(frame.df.select(e.col.getField("id").alias("x")))
        else:
            raise QueryError("DELETE takes nodes and relationships")
    nodes, edges = planner.graph.nodes[0].df, planner.graph.edges[0].df
    if edge_ids:
        gone = _all(edge_ids)
        edges = edges.join(gone, F.col("id") == F.col("x"), "left_anti")
    if node_ids:
        gone = cut_lineage(_all(node_ids))
        nodes = nodes.join(gone, F.col("id") == F.col("x"), "left_anti")
        edges = edges.join(gone, F.col("source") == F.col("x"), "left_anti").join(gone, F.col("target") == F.col("x"), "left_anti")
    _update(planner, nodes if node_ids else None, edges)
    return frame


def _all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out.where("x is not null").distinct()


# ---- merge


def merge(planner, frame: Frame, clause: A.Merge) -> Frame:
    """Rows whose pattern is there keep it; for the others it is made, once for equal patterns.

    A node of the pattern that exists by its labels and properties is used; the others and the missing
    relationships are created.
    """
    path = clause.path
    rid = fresh("rid")
    base = Frame(cut_lineage(frame.df.withColumn(rid, F.monotonically_increasing_id())), frame.vars)
    matcher = Matcher(planner.graph, {v.var: {"*"} for v in (*path.nodes, *path.rels) if v.var} | planner.need)
    named = _all_named(path)
    found = matcher.match(base, A.Match((named,), False, clause.where), planner.filter)
    found = Frame(cut_lineage(found.df), found.vars)
    lost = Frame(base.df.join(found.df.select(rid).distinct(), rid, "left_anti"), base.vars)
    created_rid = None
    if not lost.df.isEmpty():
        made = _make(planner, lost, named, clause)
        created_rid = cut_lineage(made.df.select(F.col(rid).alias("__r")))
        variables = {n.var for n in (*named.nodes, *named.rels)}
        parts = []
        for f in (found, made):
            cols = {v: f.vars[v] for v in variables if v in f.vars}
            parts.append(f.df.select(rid, *[b.id().alias(f"__{v}") for v, b in cols.items()]))
        ids = cut_lineage(parts[0].unionByName(parts[1], allowMissingColumns=True))
        right = ids.select(F.col(rid).alias("__rid"), *[F.col(c) for c in ids.columns if c != rid])
        joined = base.df.join(right, F.col(rid) == F.col("__rid"))
        renamed = {}
        for v in variables:
            c = fresh(v)
            joined = joined.withColumnRenamed(f"__{v}", c)
            renamed[v] = Edge(c, c, c, None, None) if any(r.var == v for r in named.rels) else Node(c, None, loaded=False)
        frame = refreshed(planner, Frame(joined.drop("__rid"), {**base.vars, **{v: b for v, b in renamed.items() if v not in base.vars}}))
    else:
        frame = found
    for actions, created in ((clause.on_create, True), (clause.on_match, False)):
        if not actions:
            continue
        if created_rid is None:
            if created:
                continue
            part = frame
        else:
            how = "left_semi" if created else "left_anti"
            part = Frame(frame.df.join(created_rid, F.col(rid) == F.col("__r"), how), frame.vars)
        for action in actions:
            part = write(planner, part, action)
        frame = refreshed(planner, frame)
    hidden = {n.var for n, o in zip((*named.nodes, *named.rels), (*path.nodes, *path.rels), strict=True) if not o.var}
    return Frame(frame.df.drop(rid), {v: b for v, b in frame.vars.items() if v not in hidden})


def _all_named(path: A.PathPattern) -> A.PathPattern:
    nodes = tuple(n if n.var else replace(n, var=fresh("node")) for n in path.nodes)
    rels = tuple(r if r.var else replace(r, var=fresh("rel")) for r in path.rels)
    return replace(path, nodes=nodes, rels=rels)


def _make(planner, lost: Frame, path: A.PathPattern, clause: A.Merge) -> Frame:
    """Create what is missing of the pattern for the rows; equal patterns share what is made."""
    df, variables = lost.df, dict(lost.vars)
    used: list[str] = []
    for n in path.nodes:
        if n.var in variables:
            continue
        frame = Frame(df, variables)
        props = _props(frame, n.props)
        labels = _labels(planner, n)
        sign = F.to_json(F.struct(F.lit("|".join(sorted(labels))).alias("l"), *[e.col.alias(f"p{i}") for i, (_, e) in enumerate(props)]))
        key, old = fresh("key"), fresh("old")
        df = cut_lineage(df.withColumn(key, sign))
        frame = Frame(df, variables)
        nodes, b = scan_nodes(planner.graph, n.labels)
        fits = Matcher(planner.graph, {})
        conditions: list = []
        fits._props(n, b, conditions)
        if (labels or n.props) and clause.where is None:
            on = F.lit(True)
            merged = Frame(None, {**variables, n.var: b})
            for c in conditions:
                on = on & c(merged)
            for other in used:  # a pattern's nodes are different nodes
                on = on & (F.col(other) != b.id())
            best = df.join(nodes, on).groupBy(F.col(key).alias(f"{key}b")).agg(F.min(b.id()).alias(old))
            df = df.join(best, F.col(key) == F.col(f"{key}b"), "left").drop(f"{key}b")
        else:
            df = df.withColumn(old, F.lit(None).cast("string"))
        fresh_id = fresh("made")
        if not labels and not n.props:
            df = df.withColumn(fresh_id, F.uuid())
        else:
            new = df.where(F.col(old).isNull()).select(F.col(key).alias(f"{key}n")).distinct().withColumn(fresh_id, F.uuid())
            df = df.join(cut_lineage(new), F.col(key) == F.col(f"{key}n"), "left").drop(f"{key}n")
        final = fresh(n.var)
        df = cut_lineage(df.withColumn(final, F.coalesce(old, fresh_id)))
        frame = Frame(df, variables)
        props = _props(frame, n.props)
        cols = [F.col(final).alias("id"), F.array(*[F.lit(x) for x in labels]).cast("array<string>").alias("labels"), *[e.col.alias(k) for k, e in props]]
        rows = df.where(F.col(old).isNull()).select(*cols).dropDuplicates(["id"])
        _update(planner, _union([planner.graph.nodes[0].df, rows]))
        variables[n.var] = Node(final, None, loaded=False)
        used.append(final)
    for i, r in enumerate(path.rels):
        if r.var in variables:
            continue
        a, b = variables[path.nodes[i].var], variables[path.nodes[i + 1].var]
        h = hops(planner.graph, r, generic=True)
        frame = Frame(df, variables)
        conditions = []
        Matcher(planner.graph, {})._props(r, h.edge, conditions)
        on = same_node(a, h.start) & same_node(b, h.end)
        for c in conditions:
            on = on & c(Frame(None, {**variables, r.var: h.edge}))
        sign = F.to_json(F.struct(a.id().alias("a"), b.id().alias("b"), *[e.col.alias(f"p{k}") for k, (_, e) in enumerate(_props(frame, r.props))]))
        key, old, made, final = fresh("key"), fresh("old"), fresh("made"), fresh(r.var)
        df = cut_lineage(df.withColumn(key, sign))
        best = df.join(h.df, on).groupBy(F.col(key).alias(f"{key}b")).agg(F.min(h.edge.id()).alias(old))
        df = df.join(best, F.col(key) == F.col(f"{key}b"), "left").drop(f"{key}b")
        new = cut_lineage(df.where(F.col(old).isNull()).select(F.col(key).alias(f"{key}n")).distinct().withColumn(made, F.uuid()))
        df = cut_lineage(df.join(new, F.col(key) == F.col(f"{key}n"), "left").drop(f"{key}n").withColumn(final, F.coalesce(old, made)))
        frame = Frame(df, variables)
        s, t = (b, a) if r.direction == "IN" else (a, b)
        kind = F.lit(r.types[0]) if r.types else F.lit(None).cast("string")
        cols = [F.col(final).alias("id"), s.id().alias("source"), t.id().alias("target"), kind.alias("type"), F.lit(False).alias("undirected"), *[e.col.alias(k) for k, e in _props(frame, r.props)]]
        rows = df.where(F.col(old).isNull()).select(*cols).dropDuplicates(["id"])
        _update(planner, None, _union([planner.graph.edges[0].df, rows]))
        variables[r.var] = Edge(final, final, final, None, None)
    return Frame(df, variables)


# ---- foreach


def foreach(planner, frame: Frame, clause: A.Foreach) -> Frame:
    """Apply writes to every element of a list; the rows stay as they are."""
    e = as_list(Compiler(frame.vars).value(clause.source))
    kind = STRING if is_null(e.type.elementType) else e.type.elementType
    column = fresh(clause.var)
    # an element carries what the body reads, not the list that it comes from
    used = {getattr(x, "name", None) if isinstance(x, A.Var) else getattr(x, "var", None) for x in A.walk((clause.where, clause.body))}
    outer = {v: b for v, b in frame.vars.items() if v in used and v != clause.var}
    kept = dict.fromkeys(c for b in outer.values() for c in b.columns())
    inner = Frame(frame.df.select(*kept, F.explode(e.col).alias(column)), {**outer, clause.var: Value(column, kind)})
    inner = _as_entity(planner, inner, clause.var, kind)
    if clause.where is not None:
        inner = planner.filter(inner, clause.where)
    for w in clause.body:
        inner = write(planner, inner, w)
    return refreshed(planner, frame)


def _as_entity(planner, frame: Frame, var: str, kind) -> Frame:
    """A list's nodes and relationships can be written to: bind them by id."""
    if not isinstance(kind, T.StructType) or "id" not in kind.fieldNames():
        return frame
    c = fresh(var)
    df = frame.df.withColumn(c, frame.vars[var].expr().col.getField("id")).drop(frame.vars[var].column)
    b = Edge(c, c, c, None, None) if "source" in kind.fieldNames() else Node(c, None, loaded=False)
    return refreshed(planner, Frame(df, {**frame.vars, var: b}))
