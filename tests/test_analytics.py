"""Graph statistics and centralities, against plain Python on small graphs."""

import random
from collections import deque

import pytest
from graphs import chain, diamond, make, rows, users


def star(spark):
    return make(spark, {c: {"name": c} for c in "abcd"}, [("a", "b", {}), ("a", "c", {}), ("a", "d", {})])


def test_stats(spark):
    assert rows(star(spark), "MATCH (n {name: 'a'}) RETURN numNodes() AS n, numRelationships() AS r, density() AS d, averageDegree() AS a, diameter() AS m") == [(4, 3, 0.25, 1.5, 2)]
    two = make(spark, {c: {} for c in "abcd"}, [("a", "b", {}), ("c", "d", {})])
    assert rows(two, "RETURN diameter() AS d") == [(-1,)]
    triangle = make(spark, {c: {} for c in "abc"}, [("a", "b", {}), ("b", "c", {}), ("a", "c", {})], type="undirected")
    assert rows(triangle, "RETURN density() AS d, averageDegree() AS a, diameter() AS m") == [(1.0, 2.0, 1)]
    loop = make(spark, {"a": {}}, [("a", "a", {})], type="undirected")
    assert rows(loop, "RETURN averageDegree() AS a, density() AS d, diameter() AS m") == [(1.0, 0.0, 0)]


def brandes(nodes, pairs):
    near = {v: set() for v in nodes}
    for a, b in pairs:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    score = dict.fromkeys(nodes, 0.0)
    for s in nodes:
        order, before, paths, dist, queue = [], {v: [] for v in nodes}, dict.fromkeys(nodes, 0), {s: 0}, deque([s])
        paths[s] = 1
        while queue:
            v = queue.popleft()
            order.append(v)
            for w in near[v]:
                if w not in dist:
                    dist[w] = dist[v] + 1
                    queue.append(w)
                if dist[w] == dist[v] + 1:
                    paths[w] += paths[v]
                    before[w].append(v)
        share = dict.fromkeys(nodes, 0.0)
        for w in reversed(order):
            for v in before[w]:
                share[v] += paths[v] / paths[w] * (1 + share[w])
            if w != s:
                score[w] += share[w] / 2
    return score


def pagerank(nodes, pairs):
    rank, out = dict.fromkeys(nodes, 1 / len(nodes)), {v: [b for a, b in pairs if a == v] for v in nodes}
    for _ in range(100):
        lost = sum(rank[v] for v in nodes if not out[v])
        new = {v: 0.15 / len(nodes) + 0.85 * lost / len(nodes) for v in nodes}
        for v in nodes:
            for w in out[v]:
                new[w] += 0.85 * rank[v] / len(out[v])
        moved, rank = sum(abs(new[v] - rank[v]) for v in nodes), new
        if moved < 1e-6:
            return rank
    return rank


def test_centralities(spark):
    rng = random.Random(5)
    names = [f"n{i}" for i in range(9)]
    pairs = [tuple(rng.sample(names, 2)) for _ in range(14)]
    g = make(spark, {n: {"name": n} for n in names}, [(a, b, {}) for a, b in pairs])
    got = rows(g, "MATCH (n) RETURN n.name AS n, betweennessCentrality(n) AS b, degreeCentrality(n) AS d, pagerank(n) AS p")
    expect, ranks = brandes(names, pairs), pagerank(names, pairs)
    for n, b, d, p in got:
        assert b == pytest.approx(expect[n]) and p == pytest.approx(ranks[n], abs=1e-5)
        assert d == pytest.approx(len({x for a, c in pairs for x in (a, c) if n in (a, c)} - {n}) / 8)
    (whole,) = rows(g, "RETURN degreeCentrality() AS d")
    assert whole[0] == pytest.approx({n: d for n, _, d, _ in got})


def test_subgraphs(spark):
    names = "[x IN g.nodes | x.name]"
    assert [(sorted(n), e) for n, e in rows(diamond(spark), f"MATCH (n {{name: 'b'}}) WITH egoGraph(n) AS g RETURN {names} AS n, size(g.edges) AS e")] == [(["a", "b", "d"], 3)]
    assert rows(chain(spark), "MATCH (n {name: 'C'}) WITH egoGraph(n, 2) AS g RETURN size(g.nodes) AS n, size(g.edges) AS e") == [(5, 4)]
    assert rows(users(spark), "MATCH (n {name: 'dave'}) WITH connectedComponent(n) AS g RETURN size(g.nodes) AS n, size(g.edges) AS e") == [(4, 3)]
    assert rows(users(spark), "MATCH (n) WHERE n.age < 31 WITH collect(n) AS l WITH subgraph(l) AS g RETURN size(g.nodes) AS n, size(g.edges) AS e") == [(3, 2)]
    assert rows(users(spark), "MATCH (n {name: 'bob'}) RETURN subgraph(n) AS s, egoGraph(n, -1) AS e") == [(None, None)]


def test_subgraph_members_carry_no_list(spark, monkeypatch):
    from arcweft.operators import analytics

    seen, plain = [], analytics._members

    def members(graph, rows):
        seen.append(rows.selectExpr("max(length(group))").first()[0])
        return plain(graph, rows)

    monkeypatch.setattr(analytics, "_members", members)
    g = make(spark, {f"node number {i}": {"label": "P", "k": i} for i in range(40)}, [(f"node number {i}", f"node number {i + 1}", {"type": "L"}) for i in range(39)])
    assert rows(g, "MATCH (n) WITH collect(n) AS l WITH subgraph(l) AS g RETURN size(g.nodes), size(g.edges)") == [(40, 39)]
    assert seen == [64]  # a digest, however long the list


def test_subgraph_lists_are_told_apart(spark):
    g = make(spark, {k: {"label": "P"} for k in ("a", "b", "a\x01b")}, [("a", "b", {"type": "L"})])
    assert sorted(rows(g, "UNWIND [['a', 'b'], ['a\x01b']] AS l WITH l, subgraph(l) AS g RETURN size(l), size(g.nodes), size(g.edges)")) == [(1, 1, 0), (2, 2, 1)]


def test_betweenness_folds_trees(spark, monkeypatch):
    from arcweft.operators import analytics

    met, plain = [], analytics._levels

    def levels(links, sources):
        met.append(sources.count())
        return plain(links, sources)

    monkeypatch.setattr(analytics, "_levels", levels)
    tree = [(f"n{(i - 1) // 3}", f"n{i}") for i in range(1, 30)] + [("x", "y")]
    ring = [(f"r{i}", f"r{(i + 1) % 6}") for i in range(6)] + [("r0", "r2"), ("r0", "t0"), ("t0", "t1"), ("t0", "t2"), ("r4", "t3")]
    for pairs, core in ((tree, []), (ring, [6])):
        met.clear()
        names = sorted({x for p in pairs for x in p} | {"alone"})
        got = dict(rows(make(spark, {v: {"label": "P"} for v in names}, [(a, b, {"type": "L"}) for a, b in pairs]), "MATCH (n) RETURN id(n), betweennessCentrality(n)"))
        assert got == pytest.approx(brandes(names, pairs))
        assert met == core  # only what is no tree is searched from


def test_scores_are_looked_up_without_a_map(spark, monkeypatch):
    from arcweft import QueryError
    from arcweft.operators import analytics

    g = star(spark)
    listed = rows(g, "WITH degreeCentrality() AS s RETURN s")[0][0]
    ranks = rows(g, "RETURN pagerank() AS s")[0][0]
    monkeypatch.setattr(analytics, "LARGEST", 2)
    assert rows(g, "WITH degreeCentrality() AS s RETURN size(keys(s)) AS n, s['a'] AS a, s['b'] + s['a'] AS both, s['none'] AS none") == [(4, listed["a"], listed["a"] + listed["b"], None)]
    got = rows(g, "WITH pagerank() AS s, 7 AS k MATCH (n) WITH s, n, k WHERE s[id(n)] > 0 RETURN id(n), s[id(n)], k ORDER BY s['a'], id(n)")
    assert got == [(v, pytest.approx(ranks[v]), 7) for v in "abcd"]
    for whole in ("WITH degreeCentrality() AS s RETURN s", "WITH degreeCentrality() AS s WITH s AS t RETURN t['a']", "WITH degreeCentrality() AS s RETURN *"):
        with pytest.raises(QueryError):  # one value of more than LARGEST scores
            rows(g, whole)


def test_pagerank_by_layers(spark, monkeypatch):
    from arcweft.graph import EdgeTable, NodeTable, PropertyGraph
    from arcweft.operators import analytics

    rng = random.Random(8)
    a, c = (spark.createDataFrame([(i,) for i in range(n)], "k int") for n in (9, 12))
    b = spark.createDataFrame([(f"b{i}",) for i in range(7)] + [(None,)], "k string")
    # parallel edges, ends that are no nodes, missing ends
    first = spark.createDataFrame([(rng.randint(0, 9), rng.choice(["b9", None, *[f"b{i}" for i in range(6)]])) for _ in range(30)], "s long, t string")
    second = spark.createDataFrame([(f"b{rng.randint(0, 7)}", rng.choice([None, 40, *range(9)]), rng.randint(0, 12)) for _ in range(25)], "s string, t int, u long")
    third = spark.createDataFrame([(rng.randint(0, 5), rng.randint(0, 8)) for _ in range(8)], "s int, t int")
    nodes = tuple(NodeTable(df, "k", {}, label=x) for x, df in (("A", a), ("B", b), ("C", c)))
    edges = tuple(EdgeTable(df, s, t, {}, type=kind, source_label=x, target_label=y) for df, s, t, kind, x, y in ((first, "s", "t", "X", "A", "B"), (second, "s", "t", "Y", "B", "C"), (second, "s", "u", "Z", "B", "C"), (third, "s", "t", "X", "A", "C"), (third, "s", "t", "W", "C", "Gone")))
    g = PropertyGraph(spark, nodes, edges)
    plain = analytics._ranked
    monkeypatch.setattr(analytics, "_ranked", lambda graph: pytest.fail("ranks were found round by round"))
    for rounds in (1, 100):
        monkeypatch.setattr(analytics, "ITERATIONS", rounds)
        expect = {r["id"]: r["score"] for r in plain(g).collect()}
        assert dict(rows(g, "MATCH (n) RETURN id(n), pagerank(n)")) == {k: v and pytest.approx(v, rel=1e-9) for k, v in expect.items() if k} | {None: None}
        assert dict(rows(g, "MATCH (n:C) RETURN id(n), pagerank(n)")) == {k: pytest.approx(v, rel=1e-9) for k, v in expect.items() if k and k[0] == "C"}
    monkeypatch.setattr(analytics, "_ranked", plain)
    monkeypatch.setattr(analytics, "ITERATIONS", 3)
    around = PropertyGraph(spark, nodes, (*edges, EdgeTable(third, "s", "t", {}, type="V", source_label="C", target_label="A")))
    assert analytics._layers(g) == ["A", "B", "C"] and analytics._layers(around) is None
    assert sum(s for _, s in rows(around, "MATCH (n) WHERE id(n) IS NOT NULL RETURN id(n), pagerank(n)")) < 1
