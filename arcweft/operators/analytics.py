"""Graph statistics and centralities, computed once for a query and joined to its rows.

All of them see edges in both directions unless said otherwise.  The graph's edges are reduced to pairs of
string ids; iterative ones are checkpointed through the shared folder.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import QueryError
from ..functions.typed import DOUBLE, LONG, STRING, Expr, as_list, field, is_null, is_struct
from ..graph import space_id
from ..plans.bindings import Frame, Node, fresh
from .cutting import cut_lineage

FUNCTIONS = frozenset(
    "numnodes numrelationships density averagedegree diameter pagerank degreecentrality betweennesscentrality subgraph egograph connectedcomponent".split()
)

#: Those that have a value for each node.
SCORES = frozenset(("pagerank", "degreecentrality", "betweennesscentrality"))
#: Fixed values of the PageRank iteration.
DAMPING, TOLERANCE, ITERATIONS = 0.85, 1e-6, 100
#: Sources that a search over all pairs takes at once, and nodes that one value (a map of scores, a graph) may hold.
BATCH, LARGEST = 2000, 5_000_000


def _ids(graph) -> DataFrame:
    return graph.node_frame().select("id")


def _pairs(graph) -> DataFrame:
    """(a, b, undirected) of every edge."""
    return graph.edge_frame().select(F.col("source").alias("a"), F.col("target").alias("b"), "undirected")


def _both(graph) -> DataFrame:
    """Distinct neighbours in both directions, without self loops."""
    p = _pairs(graph).where("a <> b")
    return p.select("a", "b").unionByName(p.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def _one(frame: Frame, values: DataFrame, column: str, kind) -> tuple[Frame, Expr]:
    """A single value for all rows; its table has one row."""
    name = fresh(column)
    return Frame(frame.df.crossJoin(F.broadcast(values.select(F.col(column).alias(name)))), frame.vars), Expr(F.col(name), kind)


def call(graph, frame: Frame, name: str, args: list[Expr], known: dict | None = None) -> tuple[Frame, Expr]:
    """The value of a graph function; ``known`` keeps scores for the next call on the same graph."""
    if name == "numnodes":
        return _one(frame, _ids(graph).agg(F.count("*").alias("v")), "v", LONG)
    if name == "numrelationships":
        return _one(frame, _pairs(graph).agg(F.count("*").alias("v")), "v", LONG)
    if name == "density":
        return _one(frame, density(graph), "v", DOUBLE)
    if name == "averagedegree":
        return _one(frame, average_degree(graph), "v", DOUBLE)
    if name == "diameter":
        return _one(frame, diameter(graph), "v", LONG)
    if name in SCORES:
        known = {} if known is None else known
        if name not in known:
            known[name] = {"pagerank": pagerank, "degreecentrality": degree_centrality, "betweennesscentrality": betweenness}[name](graph)
        return _scores(frame, known[name], args)
    if name == "subgraph":
        return subgraph(graph, frame, args[0])
    if name == "egograph":
        steps = args[1] if len(args) > 1 else None
        return ego(graph, frame, args[0], steps)
    return component_of(graph, frame, args[0])


def _node_id(e: Expr):
    if isinstance(e.binding, Node):
        return e.binding.id()
    return e.col.getField("id") if is_struct(e.type) and field(e.type, "id") else e.col.cast("string")


def _scores(frame: Frame, scores: DataFrame | dict, args: list[Expr]) -> tuple[Frame, Expr]:
    """The score of a node, null if it is none; without one the map of all scores by id.

    A dict has (key, score) of each label's nodes: those of a node whose label is known are found by their own keys.
    """
    if isinstance(scores, dict):
        node = args[0].binding if args else None
        if isinstance(node, Node) and node.space is not None and node.space in scores:
            key, value = fresh("key"), fresh("score")
            right = scores[node.space].select(F.col("key").alias(key), F.col("score").alias(value))
            same = F.col(node.key).cast(right.schema[key].dataType) == F.col(key)
            return Frame(frame.df.join(right, same, "left"), frame.vars), Expr(F.col(value), DOUBLE)
        scores = _all([x.select(space_id(label, F.col("key")).alias("id"), "score") for label, x in scores.items()])
    if args:
        key, value = fresh("id"), fresh("score")
        right = scores.select(F.col("id").alias(key), F.col("score").alias(value))
        return Frame(frame.df.join(right, _node_id(args[0]) == F.col(key), "left"), frame.vars), Expr(F.col(value), DOUBLE)
    if scores.limit(LARGEST + 1).count() > LARGEST:
        raise QueryError(f"a map of more than {LARGEST} scores is no single value; ask for the score of a node")
    whole = scores.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("id", "score")))).alias("v"))
    return _one(frame, whole, "v", T.MapType(STRING, DOUBLE))


def density(graph) -> DataFrame:
    """E / V(V-1), twice that for undirected graphs; 0 for fewer than two nodes."""
    n = _ids(graph).agg(F.count("*").alias("n"))
    e = _pairs(graph).agg(F.count("*").alias("e"))
    factor = 2.0 if graph.config.graph_type == "undirected" else 1.0
    pairs = F.col("n") * (F.col("n") - 1)
    return n.crossJoin(e).select(F.when(F.col("n") > 1, F.col("e") * factor / pairs).otherwise(0.0).alias("v"))


def average_degree(graph) -> DataFrame:
    """Edge ends per node; an undirected self loop counts once."""
    n = _ids(graph).agg(F.count("*").alias("n"))
    ends = F.when(F.col("undirected") & (F.col("a") == F.col("b")), 1).otherwise(2)
    e = _pairs(graph).agg(F.coalesce(F.sum(ends), F.lit(0)).alias("e"))
    return n.crossJoin(e).select(F.when(F.col("n") > 0, F.col("e") / F.col("n")).otherwise(0.0).alias("v"))


def degree_centrality(graph) -> DataFrame:
    """Distinct neighbours over V - 1."""
    n = _ids(graph).agg(F.count("*").alias("n"))
    degree = _both(graph).groupBy("a").agg(F.count("*").alias("d"))
    rows = _ids(graph).join(degree, F.col("id") == F.col("a"), "left").crossJoin(F.broadcast(n))
    return rows.select("id", F.when(F.col("n") > 1, F.coalesce("d", F.lit(0)) / (F.col("n") - 1)).otherwise(0.0).alias("score"))


def pagerank(graph) -> DataFrame | dict:
    """Damping 0.85; parallel edges count, rank of nodes without out-edges is spread over all.

    (id, score), or by label (key, score) where typed tables lead from label to label without a circle.
    """
    layers = _layers(graph)
    return _ranked(graph) if layers is None else _ranked_by_layers(graph, layers)


def _all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _key_kind(df: DataFrame, column: str) -> str | None:
    """The type as which a key is compared; None for those whose text may differ where they are equal."""
    kind = df.schema[column].dataType
    return "long" if isinstance(kind, T.IntegralType) else "string" if isinstance(kind, T.StringType) else None


def _layers(graph) -> list[str] | None:
    """The labels in an order in which every edge leads onwards; None if there is none, or not all tables are typed."""
    kinds: dict = {}
    for t in graph.nodes:
        if not t.label or ":" in t.label:
            return None
        kinds.setdefault(t.label, set()).add(_key_kind(t.df, t.key))
    ways = set()
    for t in graph.edges:
        if not t.type or not t.source_label or not t.target_label or t.undirected or t.undirected_column:
            return None
        for label, column in ((t.source_label, t.source), (t.target_label, t.target)):
            kinds.setdefault(label, set()).add(_key_kind(t.df, column))
        ways.add((t.source_label, t.target_label))
    if not graph.nodes or any(len(k) > 1 or None in k for k in kinds.values()):
        return None
    order: list = []
    while len(order) < len(kinds):
        ready = sorted(x for x in kinds if x not in order and all(a in order for a, b in ways if b == x))
        if not ready:
            return None
        order += ready
    have = {t.label for t in graph.nodes}
    return [x for x in order if x in have]


def _ranked_by_layers(graph, layers: list[str]) -> dict:
    """PageRank where edges lead from label to label without a circle: every edge is read once, whatever the rounds.

    With A the step along the edges, the ranks after k rounds are a sum over j of f(k, j) * A^j 1, and A^j 1 is nothing beyond
    the longest way between labels.  These few numbers are found for every node, label after label.  The factors of all
    rounds follow from their sums over the nodes without out-edges, and so does the round at which ranks stop moving.
    """
    depth = {x: 0 for x in layers}
    for x in layers:
        depth[x] = max([0, *(depth[t.source_label] + 1 for t in graph.edges if t.target_label == x and t.source_label in depth)])
    deep = max(depth.values())

    def key(df, column):
        return F.col(column).cast(_key_kind(df, column))

    gains: dict = {x: [] for x in layers}  # label -> (key, u1, …) that edge tables bring to its nodes
    found: dict = {}
    for x in layers:
        own = _all([t.df.select(key(t.df, t.key).alias("key")) for t in graph.nodes if t.label == x])
        names = [f"u{j}" for j in range(1, depth[x] + 1)]
        rows = own
        if gains[x]:
            sums = _all(gains[x]).groupBy("k").agg(*[F.sum(u).alias(u) for u in names])
            rows = own.join(sums, F.col("key") == F.col("k"), "left").select("key", *[F.coalesce(u, F.lit(0.0)).alias(u) for u in names])
        tables: list = []  # edge tables that share their rows and source: these are read once for all targets
        for t in graph.edges:
            if t.source_label == x:
                same = next((g for g in tables if g[0].df is t.df and g[0].source == t.source and _key_kind(t.df, t.target) == _key_kind(t.df, g[0].target)), None)
                tables.append([t]) if same is None else same.append(t)
        if not tables:
            found[x] = rows.withColumn("leaf", F.lit(True))
            continue
        degree = _all([g[0].df.groupBy(key(g[0].df, g[0].source).alias("k")).agg((F.count("*") * len(g)).alias("d")) for g in tables])
        degree = degree.groupBy("k").agg(F.sum("d").alias("d")) if len(tables) > 1 else degree
        rows = rows.join(degree, F.col("key") == F.col("k"), "left").select("key", *names, "d")
        rows = cut_lineage(rows) if gains[x] else rows
        found[x] = rows.select("key", *names, F.col("d").isNull().alias("leaf"))
        share = rows.where("d is not null").select("key", *[(v / F.col("d")).alias(f"u{j}") for j, v in enumerate([F.lit(1.0), *map(F.col, names)], 1)])
        moved = [f"u{j}" for j in range(1, depth[x] + 2)]
        for g in tables:
            ends = F.explode(F.array(*[F.struct(F.lit(i).alias("at"), key(t.df, t.target).alias("k")) for i, t in enumerate(g)]))
            links = g[0].df.select(key(g[0].df, g[0].source).alias("s"), *dict.fromkeys(t.target for t in g))
            sent = share.join(links, F.col("key") == F.col("s")).select(ends.alias("end"), *moved)
            sent = cut_lineage(sent.groupBy("end.at", "end.k").agg(*[F.sum(u).alias(u) for u in moved])) if len(g) > 1 else sent.groupBy("end.at", "end.k").agg(*[F.sum(u).alias(u) for u in moved])
            for i, t in enumerate(g):
                if t.target_label in gains:
                    zero = [F.lit(0.0).alias(f"u{j}") for j in range(len(moved) + 1, depth[t.target_label] + 1)]
                    gains[t.target_label].append(sent.where(F.col("at") == i).select("k", *moved, *zero))
    factors = _factors(found, depth, deep)
    score = {x: sum((F.col(f"u{j}") * F.lit(factors[j]) for j in range(1, depth[x] + 1)), F.lit(factors[0])) for x in layers}
    return {x: found[x].select("key", score[x].alias("score")) for x in layers}


def _factors(found: dict, depth: dict, deep: int) -> list[float]:
    """The factors of the round at which PageRank ends."""
    names = [f"u{j}" for j in range(1, deep + 1)]
    rows = [f.select("leaf", *[F.col(u) if j <= depth[x] else F.lit(0.0).alias(u) for j, u in enumerate(names, 1)]) for x, f in found.items()]
    kinds = cut_lineage(_all(rows).groupBy("leaf", *names).agg(F.count("*").alias("c")))  # many nodes are alike
    u = [F.lit(1.0), *map(F.col, names)]
    n, *lost = kinds.agg(F.sum("c"), *[F.coalesce(F.sum(F.when(F.col("leaf"), F.col("c") * v)), F.lit(0.0)) for v in u]).first()
    if not n:
        return [0.0] * (deep + 1)
    rounds = [[1.0 / n] + [0.0] * deep]
    for _ in range(ITERATIONS):
        last = rounds[-1]
        rounds.append([(1 - DAMPING) / n + DAMPING * sum(f * v for f, v in zip(last, lost, strict=True)) / n, *(DAMPING * f for f in last[:-1])])
    at, width = 0, 10
    while at < ITERATIONS:
        pairs = list(zip(rounds[at : at + width], rounds[at + 1 : at + width + 1], strict=False))
        moved = kinds.agg(*[F.sum(F.col("c") * F.abs(sum((F.lit(b - a) * v for a, b, v in zip(*p, u, strict=True)), F.lit(0.0)))) for p in pairs]).first()
        for i, m in enumerate(moved, 1):
            if m < TOLERANCE:
                return rounds[at + i]
        at += len(pairs)
    return rounds[-1]


def _ranked(graph) -> DataFrame:
    """PageRank of any graph, round by round.

    A round is one written table and one small aggregate: how far ranks moved, and the rank that leaves lose next.
    """
    nodes = cut_lineage(_ids(graph))
    n = nodes.count()
    if not n:
        return graph.spark.createDataFrame([], "id string, score double")
    p = _pairs(graph)
    out = p.select("a", "b").unionByName(p.where("undirected and a <> b").select(F.col("b").alias("a"), F.col("a").alias("b")))
    out = cut_lineage(out.groupBy("a", "b").agg(F.count("*").alias("w")))
    degree = out.groupBy("a").agg(F.sum("w").alias("d"))
    links = cut_lineage(out.join(degree, "a").select("a", "b", (F.col("w") / F.col("d")).alias("w")))
    leaves = nodes.join(degree, F.col("id") == F.col("a"), "left").select("id", F.col("a").isNull().alias("leaf"))
    ranks = cut_lineage(leaves.select("id", "leaf", F.lit(1.0 / n).alias("score"), F.lit(0.0).alias("moved")))
    lost = ranks.where("leaf").count() / n
    for _ in range(ITERATIONS):
        sent = ranks.join(links, F.col("id") == F.col("a")).groupBy("b").agg(F.sum(F.col("score") * F.col("w")).alias("in"))
        score = F.lit((1 - DAMPING) / n) + F.lit(DAMPING) * (F.coalesce("in", F.lit(0.0)) + F.lit(lost / n))
        new = ranks.select("id", "leaf", F.col("score").alias("old")).join(sent, F.col("id") == F.col("b"), "left").select("id", "leaf", "old", score.alias("score"))
        ranks = cut_lineage(new.select("id", "leaf", "score", F.abs(F.col("score") - F.col("old")).alias("moved")))
        moved, lost = ranks.agg(F.sum("moved"), F.coalesce(F.sum(F.when(F.col("leaf"), F.col("score"))), F.lit(0.0))).first()
        if moved < TOLERANCE:
            break
    return ranks.select("id", "score")


def _batches(nodes: DataFrame):
    """Sources in batches of about BATCH: what a search holds is a batch's rows of the graph, never all pairs."""
    nodes = cut_lineage(nodes)
    n = nodes.count()
    parts = -(-n // BATCH)
    for i in range(parts):
        yield n, nodes.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == i) if parts > 1 else nodes


def _levels(links: DataFrame, sources: DataFrame) -> list[DataFrame]:
    """(s, t, paths) of each level of a breadth-first search: how many shortest paths lead from s to t."""
    levels = [cut_lineage(sources.select(F.col("id").alias("s"), F.col("id").alias("t"), F.lit(1.0).alias("paths")))]
    while True:
        step = levels[-1].join(links, F.col("t") == F.col("a")).groupBy("s", F.col("b").alias("t")).agg(F.sum("paths").alias("paths"))
        for met in levels[-2:]:  # links go both ways: a neighbour lies one level up, on the same, or one down
            step = step.join(met.select("s", "t"), ["s", "t"], "left_anti")
        step = cut_lineage(step.select("s", "t", "paths"))
        if step.isEmpty():
            return levels
        levels.append(step)


def diameter(graph) -> DataFrame:
    """The longest shortest path; -1 if some pair is not connected, which the first batch of sources tells."""
    links, far = cut_lineage(_both(graph)), 0
    for n, sources in _batches(_ids(graph)):
        levels = _levels(links, sources)
        if n > 1 and sum(x.count() for x in levels) < n * levels[0].count():
            far = -1
            break
        far = max(far, len(levels) - 1)
    return graph.spark.range(1).select(F.lit(far).cast("long").alias("v"))


def _folded(links: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links that are left, weights): trees are folded into the nodes that they hang on, leaves first.

    Weights are (id, s1, s2): the sum over a node's folded branches of their sizes, and of the squares of these.  A round
    folds all nodes with a single neighbour (of two that have but each other the greater one).  Rounds end when none is
    left, or when one folds less than a thousandth of the links: a long chain is left to the search.
    """
    weights = cut_lineage(ids.select("id", F.lit(0.0).alias("s1"), F.lit(0.0).alias("s2")))
    while True:
        leaves = links.groupBy("a").agg(F.count("*").alias("n"), F.min("b").alias("b")).where("n = 1").select("a", "b")
        other = leaves.select(F.col("a").alias("c"))
        leaves = leaves.join(other, F.col("b") == F.col("c"), "left").where("c is null or a > b").select("a", "b")
        leaves = cut_lineage(leaves.join(weights, F.col("a") == F.col("id")).select("a", "b", (F.col("s1") + 1).alias("size")))
        n = leaves.count()
        if not n:
            return links, weights
        gain = leaves.groupBy("b").agg(F.sum("size").alias("g1"), F.sum(F.col("size") * F.col("size")).alias("g2"))
        weights = weights.join(gain, F.col("id") == F.col("b"), "left")
        weights = cut_lineage(weights.select("id", *[(F.col(f"s{k}") + F.coalesce(f"g{k}", F.lit(0.0))).alias(f"s{k}") for k in (1, 2)]))
        gone = leaves.select(F.col("a").alias("c"))
        links = cut_lineage(links.join(gone, F.col("a") == F.col("c"), "left_anti").join(gone, F.col("b") == F.col("c"), "left_anti"))
        if n * 1000 < links.count():
            return links, weights


def betweenness(graph) -> DataFrame:
    """Shares of shortest paths that pass a node, each pair of ends once.

    Trees are folded first: of a node with branches of sizes r1, r2, … and a rest of the component beyond them, all paths
    between two branches, or a branch and the rest, pass it.  What is left is searched, a node counting for all that is
    folded into it.  Dependencies are summed from the farthest level back, for a batch of sources at once: a node's is the
    sum over its successors of paths(node) / paths(successor) * (weight(successor) + dependency(successor)).  Batches
    leave sums by node.
    """
    every, ids = cut_lineage(_both(graph)), _ids(graph)
    links, weights = _folded(every, ids)
    parts = _components(every, ids)
    sizes = parts.groupBy("component").agg(F.count("*").alias("size"))
    size = parts.join(sizes, "component").select(F.col("id").alias("i"), "size")
    tree = (F.col("s1") * F.col("s1") - F.col("s2")) / 2 + F.col("s1") * (F.col("size") - 1 - F.col("s1"))
    rows = cut_lineage(weights.join(size, F.col("id") == F.col("i")).select("id", (F.col("s1") + 1).alias("weight"), tree.alias("tree")))
    heavy = rows.select(F.col("id").alias("i"), "weight")
    links = cut_lineage(links.join(heavy, F.col("a") == F.col("i")).select("a", "b", "weight"))
    sums = []
    for _, sources in _batches(links.select(F.col("a").alias("id"), "weight").distinct()):
        levels, below, parts = _levels(links, sources), None, []
        for here, up in zip(levels[:0:-1], levels[-2::-1], strict=True):
            here = here.withColumn("dep", F.lit(0.0)) if below is None else here.join(below, ["s", "t"], "left").withColumn("dep", F.coalesce("dep", F.lit(0.0)))
            here = cut_lineage(here.select("s", "t", "paths", "dep"))
            parts.append(here.select("s", "t", "dep"))
            up = up.select("s", F.col("t").alias("v"), F.col("paths").alias("pv"))
            flow = here.join(links, F.col("t") == F.col("a")).select("s", F.col("b").alias("v"), "paths", "weight", "dep").join(up, ["s", "v"])
            below = flow.groupBy("s", F.col("v").alias("t")).agg(F.sum(F.col("pv") / F.col("paths") * (F.col("weight") + F.col("dep"))).alias("dep"))
        if parts:
            every = parts[0]
            for p in parts[1:]:
                every = every.unionByName(p)
            every = every.join(sources.select(F.col("id").alias("s"), "weight"), "s")
            sums.append(cut_lineage(every.groupBy("t").agg(F.sum(F.col("weight") * F.col("dep")).alias("dep"))))
    if not sums:
        return rows.select("id", F.col("tree").alias("score"))
    every = sums[0]
    for p in sums[1:]:
        every = every.unionByName(p)
    score = every.groupBy(F.col("t").alias("i")).agg((F.sum("dep") / 2).alias("score"))
    return rows.join(score, F.col("id") == F.col("i"), "left").select("id", (F.col("tree") + F.coalesce("score", F.lit(0.0))).alias("score"))


# ---- subgraphs


def _of_labels(graph, ids: DataFrame):
    """The graph without the rows of typed tables that hold none of the nodes; its schema stays."""
    typed = {t.label for t in graph.nodes if t.label} | {x for t in graph.edges for x in (t.source_label, t.target_label) if x}
    if not typed:
        return graph
    label = F.substring_index("id", ":", 1)
    met = {r[0] for r in ids.select(label.alias("label")).where(label.isin(sorted({x.split(":")[0] for x in typed}))).distinct().collect()}
    gone = {x for x in typed if x.split(":")[0] not in met}

    def kept(t, *labels):
        return replace(t, df=t.df.where(F.lit(False))) if gone.intersection(labels) else t

    return replace(graph, nodes=tuple(kept(t, t.label) for t in graph.nodes), edges=tuple(kept(t, t.source_label, t.target_label) for t in graph.edges))


def _members(graph, members: DataFrame) -> tuple[DataFrame, T.DataType]:
    """(group, graph): the induced subgraph of each group's node ids, from rows (group, id)."""
    from ..plans.match import hops, scan_nodes

    members = cut_lineage(members.distinct())
    graph = _of_labels(graph, members)
    nodes, b = scan_nodes(graph, None)
    s = b.struct()
    node_rows = members.join(nodes.select(b.id().alias("id"), s.col.alias("node")), "id").groupBy("group").agg(F.sort_array(F.collect_list("node")).alias("nodes"))
    from .. import ast as A

    h = hops(graph, A.RelPattern(None, (), (), "OUT"), generic=True)
    e = h.edge.struct()
    edges = h.df.where(F.col(h.start.key) == F.col(h.edge.source))  # undirected edges once
    edges = edges.select(F.col(h.edge.source).alias("s"), F.col(h.edge.target).alias("t"), e.col.alias("edge"))
    first, second = (members.select(F.col("group").alias(g), F.col("id").alias(k)) for g, k in (("g1", "s"), ("g2", "t")))
    both = edges.join(first, "s").join(second, "t").where("g1 = g2")
    edge_rows = both.groupBy(F.col("g1").alias("g")).agg(F.sort_array(F.collect_list("edge")).alias("edges"))
    kind = T.StructType([T.StructField("nodes", T.ArrayType(s.type)), T.StructField("edges", T.ArrayType(e.type))])
    out = node_rows.join(edge_rows, F.col("group") == F.col("g"), "left")
    return out.select("group", F.struct("nodes", F.coalesce("edges", F.array().cast(T.ArrayType(e.type))).alias("edges")).alias("graph")), kind


def _join_graph(frame: Frame, key, rows: DataFrame, kind) -> tuple[Frame, Expr]:
    g, v = fresh("group"), fresh("graph")
    rows = rows.select(F.col("group").alias(g), F.col("graph").alias(v))
    return Frame(frame.df.join(rows, key == F.col(g), "left"), frame.vars), Expr(F.col(v), kind)


def subgraph(graph, frame: Frame, nodes: Expr) -> tuple[Frame, Expr]:
    """Nodes of a list with the edges between them; null for anything but a list."""
    if not isinstance(nodes.type, T.ArrayType):
        return frame, Expr(F.lit(None), T.NullType())
    items = as_list(nodes)
    ids = F.transform(items.col, lambda x: x.getField("id") if is_struct(items.type.elementType) else x.cast("string"))
    column, key = fresh("ids"), fresh("key")
    df = frame.df.withColumn(column, F.array_sort(F.array_distinct(ids)))
    df = df.withColumn(key, F.sha2(F.to_json(column), 256))  # each member carries its list's digest, never the list
    members = df.select(F.col(key).alias("group"), F.explode(column).alias("id"))
    rows, kind = _members(graph, members)
    f, e = _join_graph(Frame(df, frame.vars), F.col(key), rows, kind)
    none = F.struct(F.array().cast(kind["nodes"].dataType).alias("nodes"), F.array().cast(kind["edges"].dataType).alias("edges"))
    return f, Expr(F.when(F.col(column).isNotNull(), F.coalesce(e.col, none)), kind)


def ego(graph, frame: Frame, node: Expr, steps: Expr | None) -> tuple[Frame, Expr]:
    """Nodes within so many steps in either direction, with the edges between them."""
    if is_null(node.type) and node.binding is None:
        return frame, Expr(F.lit(None), T.NullType())
    key = _node_id(node)
    k = 1
    if steps is not None:
        values = [r[0] for r in frame.df.select(steps.col.cast("int")).distinct().limit(2).collect()]
        if len(values) > 1:
            raise QueryError("egoGraph takes the same number of steps for all rows")
        k = values[0] if values and values[0] is not None else 1
    if k < 0:
        return frame, Expr(F.lit(None), T.NullType())
    links = _both(graph)
    known = frame.df.select(key.alias("group")).where("group is not null").distinct().select("group", F.col("group").alias("id"))
    edge = known
    for _ in range(k):
        step = edge.join(links, F.col("id") == F.col("a")).select("group", F.col("b").alias("id")).distinct()
        edge = cut_lineage(step.join(known, ["group", "id"], "left_anti"))
        known = cut_lineage(known.unionByName(edge))
    rows, kind = _members(graph, known)
    return _join_graph(frame, key, rows, kind)


def labels_of_components(graph) -> DataFrame:
    """(id, component): the least id that can be reached."""
    return _components(cut_lineage(_both(graph)), _ids(graph))


def _components(links: DataFrame, ids: DataFrame) -> DataFrame:
    """Components by spreading least labels with pointer jumps."""
    state = cut_lineage(ids.select("id", F.col("id").alias("component")))
    while True:
        near = links.join(state, F.col("b") == F.col("id")).groupBy("a").agg(F.min("component").alias("low"))
        new = state.join(near, F.col("id") == F.col("a"), "left").select("id", "component", F.least("component", F.coalesce("low", "component")).alias("next"))
        jump = new.select(F.col("id").alias("j"), F.col("next").alias("far"))
        new = new.join(jump, F.col("next") == F.col("j"), "left").select("id", F.col("component").alias("old"), F.coalesce("far", "next").alias("component"))
        new = cut_lineage(new)
        if new.where("old <> component").isEmpty():
            return new.select("id", "component")
        state = new.select("id", "component")


def component_of(graph, frame: Frame, node: Expr) -> tuple[Frame, Expr]:
    """Everything that can be reached from a node in either direction."""
    if is_null(node.type) and node.binding is None:
        return frame, Expr(F.lit(None), T.NullType())
    parts = labels_of_components(graph)
    wanted = frame.df.select(_node_id(node).alias("n")).distinct().join(parts, F.col("n") == F.col("id"))
    wanted = wanted.select(F.col("n"), F.col("component").alias("group"))
    members = cut_lineage(parts.join(wanted.select("group").distinct(), F.col("component") == F.col("group")).select("group", "id"))
    largest = members.groupBy("group").count().agg(F.max("count")).first()[0] or 0
    if largest > LARGEST:
        raise QueryError(f"a component of {largest} nodes is no single value; MATCH its nodes instead")
    rows, kind = _members(graph, members)
    n, g = fresh("node"), fresh("component")
    df = frame.df.join(wanted.select(F.col("n").alias(n), F.col("group").alias(g)), _node_id(node) == F.col(n), "left")
    return _join_graph(Frame(df, frame.vars), F.col(g), rows, kind)
