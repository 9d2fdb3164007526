"""Variable-length hops and shortest paths: level by level joins over distinct frontiers."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import QueryError
from ..functions.typed import Expr, convert
from ..plans.bindings import Frame, Node, Value, fresh
from .cutting import cut_lineage

#: Levels that are planned as one; longer ones are written and checked for emptiness level by level.
UNROLLED = 4
#: Of all combinations of two frames: rows that a task makes, rows of the lesser frame that are broadcast, entries of a bucket.
MADE, SENT, BUCKET = 4_000_000, 20_000, 8
#: Rows of a search's level that are broadcast to the edges instead of being shuffled with them.
NEAR = 200_000


def _edges(graph, rel, labels=None, bare: bool = False, right=(None, None)):
    """Edges as (a, b, rel), from nodes of the labels where these are known, and the labels that they lead to.

    ``right`` is the label term and the known label of their ends.

    ``bare`` edges are (a, b): their relationships are read by nobody.
    """
    from .. import ast as A
    from ..plans.match import bare_hops, hops, oriented

    term = A.LabelTerm(tuple(((x, False),) for x in sorted(labels))) if labels else None
    ends = {t.source_label if back else t.target_label for t, back in oriented(graph, rel, (term, None), right)}
    reached = None if None in ends or labels is None else ends
    if bare:
        return bare_hops(graph, rel, (term, None), right), T.StringType(), reached
    h = hops(graph, rel, (term, None), right, generic=True)
    s = h.edge.struct()
    df = h.df.select(F.col(h.start.key).alias("a"), F.col(h.end.key).alias("b"), s.col.alias("rel"))
    df = _filtered(df, rel, s.type)
    return df, s.type, reached


def _filtered(df: DataFrame, rel, kind) -> DataFrame:
    from .. import ast as A
    from ..plans.expressions import Compiler

    for key, expr in rel.props:
        if any(isinstance(x, A.Var) for x in A.walk(expr)):
            raise QueryError("a variable-length relationship's properties must be constants")
        df = df.where(Compiler({"r": Expr(F.col("rel"), kind)}).condition(A.Binary("=", A.Prop(A.Var("r"), key), expr)))
    return df


def expand(matcher, frame: Frame, left: Node, rel, path, flipped: bool, right, alone: bool):
    """Paths of a variable-length hop: no node twice, a self loop only as the last step.

    Returns the frame joined with them, the list of relationships, the far end, and the nodes in between.
    Paths start at the distinct nodes that the frame has, not at all nodes, and carry their relationships only
    where the query reads them.  Short hops are one plan; longer ones are written level by level.  ``right`` is the label
    term and the known label of the far end: typed tables that can't end a path are not followed in the last step.  If
    the frame is ``alone``, a scan of the start, short paths carry its row and need no join back.
    """
    from ..plans.match import accepts

    graph = matcher.graph
    want_nodes = path.var is not None
    want_rels = want_nodes or matcher.whole(rel.var) or matcher.reads(rel.var)
    bare = not want_rels and not rel.props
    kind = T.StringType() if bare else _edges(graph, rel)[1]
    low, high = rel.low, rel.high
    if high < 0:
        high = graph.config.max_var_length_depth
        warnings.warn(f"unbounded variable-length relationship: paths of up to {high} steps are followed (max_var_length_depth)", stacklevel=2)
    limit, stop = graph.config.max_paths, graph.config.on_excess == "stop"
    list_type = T.ArrayType(kind)
    starts = frame.df.select(left.id().alias("start")).where(F.col("start").isNotNull()).distinct()
    empty = F.array().cast(list_type)
    lazily = high <= UNROLLED and limit is None
    carried = frame.df.columns if alone and lazily else []
    if carried:
        starts = frame.df.withColumn("start", left.id()).where("start is not null")
    level = starts.select("start", *carried, F.col("start").alias("last"), F.array("start").alias("seen"), *[empty.alias("rels")] * want_rels, F.lit(False).alias("ended"))
    total = 0
    # typed tables: a level only reads the edge tables that leave the labels reached so far
    labels = {left.label} if left.label else None
    found, ends = ([level], [labels]) if low == 0 else ([], [])
    for depth in range(1, high + 1):
        if labels is not None and not labels:
            break
        edges, own, labels = _edges(graph, rel, labels, bare, right if depth == high and limit is None else (None, None))
        edges = edges.where("b is not null")  # a foreign key without a value leads nowhere
        edges = edges.withColumn("rel", convert(Expr(F.col("rel"), own), kind)) if want_rels else edges.select("a", "b")
        step = level.where("not ended").join(edges, F.col("last") == F.col("a"))
        if depth > 2:
            step = step.where((F.col("b") == F.col("last")) | ~F.array_contains("seen", F.col("b")))
        elif depth == 2 and (labels is None or left.label in labels):  # no other node can be met again
            step = step.where((F.col("b") == F.col("last")) | (F.col("b") != F.col("start")))
        rels = F.concat(F.array("rel"), "rels") if flipped else F.concat("rels", F.array("rel"))
        seen = F.concat(F.array("b"), "seen") if flipped else F.concat("seen", F.array("b"))
        level = step.select("start", *carried, F.col("b").alias("last"), seen.alias("seen"), *[rels.alias("rels")] * want_rels, (F.col("b") == F.col("last")).alias("ended"))
        if not lazily:
            level = cut_lineage(level)
            n = level.count()
            if not n:
                break
            if depth >= low:
                total += n
            if limit is not None and total > limit:
                if not stop:
                    raise QueryError(f"more than {limit} paths; narrow the pattern or raise max_paths")
                warnings.warn(f"more than {limit} paths: the first ones by length are kept (max_paths)", stacklevel=2)
                found.append(level.limit(n - (total - limit)))
                break
        if depth >= low and (labels is None or limit is not None or any(accepts(x, *right) for x in labels)):
            found.append(level)
            ends.append(labels)
    out = _union(found) if found else level.limit(0)
    reached = set().union(*ends) if ends and all(x is not None for x in ends) else set()
    label = next(iter(reached)) if len(reached) == 1 else None
    start, last, rels, seen = fresh("start"), fresh("end"), fresh(rel.var or "rels"), fresh("seen")
    out = out.select(*carried, F.col("start").alias(start), F.col("last").alias(last), (F.col("rels") if want_rels else empty).alias(rels), F.col("seen").alias(seen))
    inner = None
    df = out if carried else frame.df.join(out, left.id() == F.col(start))
    if want_nodes:
        df, inner = _attach_nodes(graph, df, seen)
    return Frame(df, frame.vars), Value(rels, list_type), Node(last, None, label, loaded=False), inner


def count_paths(graph, df: DataFrame, left: Node, rel, right) -> tuple[DataFrame, str] | None:
    """The rows with paths and the column of how many each has, or None where paths must be listed to be counted.

    Where no label can come again on the way, every walk along typed tables is a path: numbers are added up by node from the
    far end, level by level.  Tables that lead to no end are not read.  ``right`` is as in ``expand``.
    """
    from .. import ast as A
    from ..plans.match import accepts, bare_hop, oriented

    low, high = rel.low, rel.high if rel.high >= 0 else graph.config.max_var_length_depth
    if left.label is None or graph.config.max_paths is not None:
        return None
    levels, labels = [], {left.label}
    for depth in range(1, high + 1):
        term = A.LabelTerm(tuple(((x, False),) for x in sorted(labels)))
        tables = [(t, back, *(t.source_label, t.target_label)[:: -1 if back else 1]) for t, back in oriented(graph, rel, (term, None), right if depth == high else (None, None))]
        if any(a is None or b is None for *_, a, b in tables):
            return None
        levels.append(tables)
        labels = {b for *_, b in tables}
    leading: set = set()  # labels from which a level leads on to an end
    for depth in range(high, 0, -1):
        levels[depth - 1] = [(*x, depth >= low and accepts(x[3], *right), x[3] in leading) for x in levels[depth - 1]]
        levels[depth - 1] = [x for x in levels[depth - 1] if x[4] or x[5]]
        leading = {x[2] for x in levels[depth - 1]}
    passed: dict = {left.label: set()}  # labels that a path to a label can have passed
    for tables in levels:
        if any(b in passed[a] or (a == b and leads) for _, _, a, b, _, leads in tables):  # a self loop may only be the last step
            return None
        passed = {b: set().union(*(passed[x[2]] | {x[2]} for x in tables if x[3] == b)) for _, _, _, b, *_ in tables}
    if rel.high < 0:
        warnings.warn(f"unbounded variable-length relationship: paths of up to {high} steps are followed (max_var_length_depth)", stacklevel=2)
    onward = None  # by node, how many ways there are from a level on
    for tables in reversed(levels):
        last, more = None, None  # the level's edges that end paths, and those that others follow
        for t, back, _, _, ends, leads in tables:
            one = bare_hop(t, back, rel).where("a is not null and b is not null").withColumn("n", F.lit(int(ends)).cast("long"))
            if leads:
                more = one if more is None else more.unionByName(one)
            else:
                last = one if last is None else last.unionByName(one)
        if more is not None:
            more = more.join(onward, F.col("b") == F.col("node"), "left" if any(x[4] and x[5] for x in tables) else "inner")
            more = more.withColumn("n", F.col("n") + F.coalesce("more", F.lit(0))).where("n > 0").select("a", "b", "n")
        steps = _union([x for x in (last, more) if x is not None]) if tables else None
        onward = None if steps is None else steps.groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("more"))
    none = low == 0 and accepts(left.label, *right)  # paths without a step
    node, times = fresh("node"), fresh("times")
    df = df.where(left.id().isNotNull())
    if onward is None:
        return df.where(F.lit(none)).withColumn(times, F.lit(1).cast("long")), times
    df = df.join(onward.select(F.col("node").alias(node), F.col("more").alias(times)), left.id() == F.col(node), "left" if none else "inner")
    return (df.withColumn(times, F.coalesce(F.col(times), F.lit(0)) + 1) if none else df), times


def _attach_nodes(graph, df: DataFrame, seen: str):
    """The nodes strictly between the ends of ``seen``, as structs in order."""
    from ..plans.match import scan_nodes

    nodes, b = scan_nodes(graph, None)
    s = b.struct()
    ways = df.select(F.col(seen).alias("w")).distinct()
    parts = ways.select("w", F.posexplode(F.when(F.size("w") > 2, F.slice("w", F.lit(2), F.size("w") - 2)).otherwise(F.array().cast("array<string>"))).alias("k", "i"))
    parts = parts.join(nodes.select(b.id().alias("i"), s.col.alias("node")), "i").groupBy("w").agg(F.array_sort(F.collect_list(F.struct("k", "node")), _by_position).alias("l"))
    column, key = fresh("mid"), fresh("way")
    parts = parts.select(F.col("w").alias(key), F.transform("l", lambda x: x.getField("node")).alias(column))
    kind = T.ArrayType(s.type)
    df = df.join(parts, F.col(seen) == F.col(key), "left").withColumn(column, F.coalesce(F.col(column), F.array().cast(kind)))
    return df, Expr(F.col(column), kind)


@dataclass(frozen=True)
class _Pairs:
    """The pairs (start, goal) that a search is for."""

    pairs: DataFrame

    def starts(self) -> DataFrame:
        return self.pairs.groupBy("start").agg(F.count("*").alias("left"))

    def met(self, level: DataFrame) -> DataFrame:
        return level.withColumnRenamed("node", "goal").join(self.pairs, ["start", "goal"]).select("start", "goal", "paths")


@dataclass(frozen=True)
class _Product:
    """Every pair of a start and one of n goals: the pairs themselves are never written."""

    begin: DataFrame
    goals: DataFrame
    n: int

    def starts(self) -> DataFrame:
        return self.begin.select("start", F.lit(self.n).cast("long").alias("left"))

    def met(self, level: DataFrame) -> DataFrame:
        return level.withColumnRenamed("node", "goal").join(self.goals, "goal", "left_semi").select("start", "goal", "paths")


def _toward(graph, rel, goal: str | None, steps: int):
    """The graph with the edge tables only by which a label may still be reached, in so many steps after them (-1: any)."""
    from ..plans.match import oriented

    ways = [(t, (t.target_label, t.source_label) if back else (t.source_label, t.target_label)) for t, back in oriented(graph, rel)]
    if goal is None or any(None in w for _, w in ways):
        return graph
    leading = {goal}
    for _ in range(len(ways) if steps < 0 else min(steps, len(ways))):
        leading |= {a for _, (a, b) in ways if b in leading}
    return replace(graph, edges=tuple(t for t in graph.edges if any(x is t and w[1] in leading for x, w in ways)))


def _search(graph, a: Node, b: Node, rel, wanted: _Pairs | _Product, counted: bool = False):
    """Levels (start, node, paths), the labels that each was reached from, and hits (start, goal, paths) by level.

    A level holds the distinct nodes that each start first meets there, and if ``counted`` how many shortest paths lead
    to them (else 1: such numbers can outgrow a long).  Edges
    are pairs of ids, of the tables only that leave the labels reached so far and end where a goal is still in reach.  Levels
    of few rows are sent to the edges' stored keys.  The
    search ends when all pairs are found, a level is empty, or the pattern's bound is reached.
    """
    from .. import ast as A
    from ..plans.match import bare_steps

    high = 1 if rel.low is None else rel.high
    one = F.lit(1).cast("long").alias("paths")
    levels = [wanted.starts().select("start", F.col("start").alias("node"), one)]
    none = levels[0].select("start", F.col("node").alias("goal"), "paths").limit(0)
    hits = [None if a.label and b.label and a.label != b.label else wanted.met(levels[0])]
    labels = {a.label} if a.label else None
    sources, met, left, size = [], [labels], None, levels[0].count()
    while high < 0 or len(levels) <= high:
        if labels is not None and not labels:
            break
        live = levels[-1] if left is None else levels[-1].join(left.select("start"), "start", "left_semi")
        near = _toward(graph, rel, b.label, -1 if high < 0 else high - len(levels))
        ways, _, reached = _edges(near, rel, labels, bare=not rel.props)
        if reached is not None and not reached:
            break
        if size <= NEAR and not rel.props:
            step = bare_steps(near, rel, live, (A.LabelTerm(tuple(((x, False),) for x in sorted(labels))) if labels else None, None))
        else:
            step = live.join(ways.where("a <> b").select("a", "b"), F.col("node") == F.col("a")).select("start", F.col("b").alias("node"), "paths")
        step = step.groupBy("start", "node").agg((F.sum if counted else F.max)("paths").alias("paths"))
        again = [x for x, own in zip(levels, met, strict=True) if own is None or reached is None or own & reached]
        if again:
            step = step.join(_union([x.select("start", "node") for x in again]), ["start", "node"], "left_anti")
        level = cut_lineage(step.select("start", "node", "paths"))
        size = level.count()
        if not size:
            break
        levels.append(level)
        sources.append(labels)
        met.append(reached)
        labels = reached
        if b.label and reached is not None and b.label not in reached:
            hits.append(None)
            continue
        hits.append(cut_lineage(wanted.met(level)))
        if high < 0 or len(levels) <= high:
            found = _union([h for h in hits if h is not None]).groupBy("start").agg(F.count("*").alias("found"))
            left = wanted.starts().join(found, "start", "left").where(F.col("left") > F.coalesce("found", F.lit(0)))
            left = cut_lineage(left.select("start"))
            if left.isEmpty():
                break
    return levels, sources, [none if h is None else h for h in hits]


def _pairs(frame: Frame, a: Node, b: Node) -> _Pairs:
    return _Pairs(cut_lineage(frame.df.select(a.id().alias("start"), b.id().alias("goal")).where("start is not null and goal is not null").distinct()))


def _measures(hits: list[DataFrame], rel, every: bool) -> DataFrame:
    """(start, goal, measure) of the pairs that are found."""
    low = 1 if rel.low is None else rel.low
    out = [h.withColumn("steps", F.lit(i).cast("long")) for i, h in enumerate(hits) if i >= low or i == 0]
    return _union(out).select("start", "goal", F.col("paths" if every else "steps").alias("measure"))


def measured(graph, frame: Frame, a: Node, b: Node, rel, every: bool) -> tuple[Frame, Expr]:
    """How many shortest paths there are between two bound nodes of each row, or their length: no path is built."""
    sides = [[i for i, f in enumerate(frame.factors) if x.key in f.df.columns] for x in (a, b)]
    if sides in ([[0], [1]], [[1], [0]]):
        return _measured_product(graph, frame, a, b, rel, every, sides[0][0])
    hits = _search(graph, a, b, rel, _pairs(frame, a, b), every)[2]
    s, g, v = fresh("start"), fresh("goal"), fresh("measure")
    out = _measures(hits, rel, every).select(F.col("start").alias(s), F.col("goal").alias(g), F.col("measure").alias(v))
    df = frame.df.join(out, (a.id() == F.col(s)) & (b.id() == F.col(g)), "left")
    return Frame(df, frame.vars), Expr(F.coalesce(F.col(v), F.lit(0).cast("long")) if every else F.col(v), T.LongType())


def _measured_product(graph, frame: Frame, a: Node, b: Node, rel, every: bool, at: int) -> tuple[Frame, Expr]:
    """The same where the rows are all combinations of two frames, the one at ``at`` with the start.

    The combinations are neither searched for nor joined: what the search finds is gathered by node of the larger frame, its
    rows carry that, and a combination looks its value up.  A row's finds lie in buckets by hash, so that a look takes
    about the same time however many there are, and a mask of 64 bits by hash tells most combinations that there is nothing to
    look for.  Nodes are told apart by their stored keys where these are whole numbers.  If far fewer goals than starts are asked for, the search goes from them.
    """
    frames = {"start": frame.factors[at], "goal": frame.factors[1 - at]}
    nodes = {"start": a, "goal": b}
    ids = {k: cut_lineage(f.df.select(nodes[k].id().alias(k)).where(F.col(k).isNotNull()).distinct()) for k, f in frames.items()}
    n = {k: d.count() for k, d in ids.items()}
    if n["goal"] * 10 <= n["start"]:
        turned = replace(rel, direction={"OUT": "IN", "IN": "OUT"}.get(rel.direction, rel.direction))
        wanted = _Product(ids["goal"].withColumnRenamed("goal", "start"), ids["start"].withColumnRenamed("start", "goal"), n["start"])
        hits = _search(graph, b, a, turned, wanted, every)[2]
        hits = [h.select(F.col("goal").alias("start"), F.col("start").alias("goal"), "paths") for h in hits]
    else:
        hits = _search(graph, a, b, rel, _Product(ids["start"], ids["goal"], n["goal"]), every)[2]
    many, few = ("start", "goal") if n["start"] >= n["goal"] else ("goal", "start")
    parts = max(graph.spark.sparkContext.defaultParallelism, min(-(-n["start"] * n["goal"] // MADE), 10_000))
    key, finds, mask, last, other, bit, place = (fresh(x) for x in ("id", "finds", "mask", "last", "id", "bit", "place"))
    node = nodes[few]
    stored = node.space is not None and isinstance(frames[few].df.schema[node.key].dataType, T.IntegralType)
    # entries, and for each bucket one without a node so that none is missing; a hash's low six bits are for the mask
    found = _measures(hits, rel, every).select(many, (F.substring(few, len(node.space) + 2, 2**31 - 1).cast("long") if stored else F.col(few)).alias("k"), F.col("measure").alias("v"))
    found = found.withColumn("h", F.xxhash64("k")).repartition(parts, F.col(many)).groupBy(many).agg(F.collect_list(F.struct("k", "v", "h")).alias("l"), F.bit_or(_bit("h")).alias(mask))
    found = found.withColumn(last, F.pow(F.lit(2), F.ceil(F.log2(F.ceil(F.size("l") / BUCKET)))).cast("int") - 1)
    empty = F.transform(F.sequence(F.lit(0), F.col(last)), lambda i: F.struct(F.lit(None).cast("long" if stored else "string").alias("k"), F.lit(None).cast("long").alias("v"), F.shiftleft(i.cast("long"), 6).alias("h")))
    found = found.select(many, mask, last, F.explode(F.concat("l", empty)).alias("x"))
    found = found.groupBy(many, mask, last, _bucket(F.col("x.h"), F.col(last)).alias("at"))
    found = found.agg(F.collect_list(F.when(F.col("x.k").isNotNull(), F.struct("x.k", "x.v"))).alias("l")).groupBy(many, mask, last).agg(F.array_sort(F.collect_list(F.struct("at", "l"))).alias("l"))
    found = found.select(F.col(many).alias(key), mask, last, F.transform("l", lambda x: F.map_from_entries(x.getField("l"))).alias(finds))
    own = fresh("id")
    rows = frames[many].df.withColumn(own, nodes[many].id()).repartition(parts, F.col(own)).join(found, F.col(own) == F.col(key), "left").drop(own, key)
    lesser = frames[few].df.withColumn(other, F.col(node.key).cast("long") if stored else node.id()).withColumn(place, F.xxhash64(other)).withColumn(bit, _bit(place))
    one, two = Frame(rows, frames[many].vars), Frame(lesser, frames[few].vars)
    flat = not any(isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) for f in lesser.schema.fields)
    sent = F.broadcast(lesser) if flat and n[few] <= SENT and lesser.limit(SENT + 1).count() <= SENT else lesser
    # each column is named once: Spark's code then reads the finds in that branch only
    value = F.when(F.col(mask).bitwiseAND(F.col(bit)) != 0, F.get(F.col(finds), _bucket(F.col(place), F.col(last)))[F.col(other)])
    return Frame(rows.crossJoin(sent), frame.vars, (one, two)), Expr(F.coalesce(value, F.lit(0).cast("long")) if every else value, T.LongType())


def _bit(place) -> Column:
    """One of 64 bits, by the low bits of a hash."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.col(place).bitwiseAND(F.lit(63)).cast("int"))


def _bucket(place: Column, last: Column) -> Column:
    """One of the buckets up to the last, a power of two in number, by the other bits of a hash."""
    return F.shiftright(place, 6).bitwiseAND(last).cast("int")


def shortest(graph, frame: Frame, a: Node, b: Node, rel, every: bool) -> tuple[Frame, Expr]:
    """Shortest paths between two bound nodes of each row, as path structs (a list of them for ``every``).

    One breadth-first search over all distinct pairs of the frame.  Going back from the goals marks the nodes that lie on
    a shortest path; paths are built over those alone, and only then are relationships read.
    """
    low = 1 if rel.low is None else rel.low
    kind = _edges(graph, rel)[1]
    list_type = T.ArrayType(kind)
    levels, sources, hits = _search(graph, a, b, rel, _pairs(frame, a, b))
    hits = [h.select("start", "goal") for h in hits]
    # back from the goals: (start, goal, node) of the nodes on a shortest path, by level
    marked = [hits[-1].withColumn("node", F.col("goal"))]
    for level, labels, hit in zip(levels[-2::-1], sources[::-1], hits[-2::-1], strict=True):
        ways = _edges(graph, rel, labels, bare=not rel.props)[0].where("a <> b").select("a", "b")
        before = marked[0].join(ways, F.col("node") == F.col("b")).select("start", "goal", F.col("a").alias("node")).distinct()
        marked.insert(0, cut_lineage(before.join(level, ["start", "node"], "left_semi").select("start", "goal", "node").unionByName(hit.withColumn("node", F.col("goal")))))
    # forward again, over the marked nodes only
    part = marked[0].withColumn("ids", F.array("node")).withColumn("rels", F.array().cast(list_type))
    done = [part.where("node = goal")]
    for mark, labels in zip(marked[1:], sources, strict=True):
        ways, own, _ = _edges(graph, rel, labels)
        ways = ways.where("a <> b").withColumn("rel", convert(Expr(F.col("rel"), own), kind))
        step = part.where("node <> goal").join(ways, F.col("node") == F.col("a")).drop("node").withColumnRenamed("b", "node")
        step = step.join(mark, ["start", "goal", "node"], "left_semi")
        step = step.select("start", "goal", "node", F.concat("ids", F.array("node")).alias("ids"), F.concat("rels", F.array("rel")).alias("rels"), F.col("rel").getField("id").alias("by"))
        if not every:  # ties: the least sequence of edge ids
            step = step.groupBy("start", "goal").agg(F.min_by(F.struct("node", "ids", "rels"), F.struct("by", "node")).alias("s")).select("start", "goal", "s.*")
        part = cut_lineage(step.select("start", "goal", "node", "ids", "rels"))
        done.append(part.where("node = goal"))
    out = _union(done).select("start", "goal", "ids", "rels")
    # a path shorter than the pattern's least length doesn't count, but a node reaches itself
    out = out.where((F.size("rels") >= low) | (F.size("rels") == 0))
    out, node_type = _with_nodes(graph, out)
    path_type = T.StructType([T.StructField("nodes", T.ArrayType(node_type)), T.StructField("relationships", list_type)])
    s, g, p = fresh("start"), fresh("goal"), fresh("path")
    whole = F.struct(F.col("nodes"), F.col("rels").alias("relationships"))
    if every:
        out = out.groupBy("start", "goal").agg(F.collect_list(whole).alias(p))
    else:
        out = out.select("start", "goal", whole.alias(p))
    out = out.select(F.col("start").alias(s), F.col("goal").alias(g), p)
    df = frame.df.join(out, (a.id() == F.col(s)) & (b.id() == F.col(g)), "left")
    if every:
        return Frame(df, frame.vars), Expr(F.coalesce(F.col(p), F.array().cast(T.ArrayType(path_type))), T.ArrayType(path_type))
    return Frame(df, frame.vars), Expr(F.col(p), path_type)


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _with_nodes(graph, paths: DataFrame):
    from ..plans.match import scan_nodes

    nodes, b = scan_nodes(graph, None)
    s = b.struct()
    steps = paths.select("ids").distinct().select("ids", F.posexplode("ids").alias("k", "i"))
    steps = steps.join(nodes.select(b.id().alias("i"), s.col.alias("node")), "i")
    steps = steps.groupBy("ids").agg(F.array_sort(F.collect_list(F.struct("k", "node")), _by_position).alias("l"))
    steps = steps.select("ids", F.transform("l", lambda x: x.getField("node")).alias("nodes"))
    return paths.join(steps, "ids"), s.type


def _by_position(x, y):
    return x.getField("k") - y.getField("k")

