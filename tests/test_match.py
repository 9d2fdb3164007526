"""Patterns: scans, hops, optional and chained matches, variable length, paths."""

import pytest
from graphs import chain, diamond, make, rows, users

from arcweft import GraphConfig, PropertyGraph, QueryError


@pytest.fixture(scope="module")
def u(spark):
    return users(spark)


def test_scan_and_property_map(u):
    assert rows(u, "MATCH (n:User {name: 'bob'}) RETURN n.age AS a") == [(25,)]
    assert rows(u, "MATCH (n:User {age: '25'}) RETURN n.age AS a") == []  # types are not converted
    assert rows(u, "MATCH (n:Nobody) RETURN n") == []


def test_directions(u):
    assert rows(u, "MATCH (a)-[:FRIEND]->(b) RETURN a.name AS a, b.name AS b ORDER BY a") == [("alice", "bob"), ("bob", "charlie")]
    assert rows(u, "MATCH (a)<-[:FRIEND]-(b) RETURN a.name AS a, b.name AS b ORDER BY a") == [("bob", "alice"), ("charlie", "bob")]
    assert rows(u, "MATCH (a {name: 'bob'})--(b) RETURN b.name AS b ORDER BY b") == [("alice",), ("charlie",)]
    assert rows(u, "MATCH (a {name: 'bob'})<-->(b) RETURN count(b) AS c") == [(2,)]


def test_several_types_and_relationship_properties(u):
    assert rows(u, "MATCH (a {name: 'alice'})-[r:FRIEND|KNOWS]->(b) RETURN type(r) AS t, startnode(r) AS s, endnode(r) AS e ORDER BY t") == [("FRIEND", "alice", "bob"), ("KNOWS", "alice", "dave")]
    assert rows(u, "MATCH ()-[r {type: 'KNOWS'}]->(b) RETURN r.source AS s, r.target AS t, r.id = id(r) AS same") == [("alice", "dave", True)]


def test_node_may_be_met_again(u):
    assert rows(u, "MATCH (a {name: 'bob'})--(b)--(c) RETURN c.name AS c ORDER BY c") == [("bob",), ("bob",), ("dave",)]


def test_multi_hop_and_repeated_variable(u, spark):
    assert rows(u, "MATCH (a)-[:FRIEND]->(b)-[:FRIEND]->(c) RETURN a.name AS a, c.name AS c") == [("alice", "charlie")]
    g = make(spark, {"x": {"label": "A"}, "y": {"label": "A"}}, [("x", "y", {"type": "T"}), ("y", "x", {"type": "T"}), ("x", "x", {"type": "T"})])
    assert rows(g, "MATCH (a)-[:T]->(b)-[:T]->(a) RETURN id(a) AS a, id(b) AS b ORDER BY a, b") == [("x", "x"), ("x", "y"), ("y", "x")]


def test_chained_matches_share_variables(u):
    assert rows(u, "MATCH (a {name: 'alice'}) MATCH (a)-->(b) RETURN b.name AS b ORDER BY b") == [("bob",), ("dave",)]
    assert rows(u, "MATCH (b {name: 'bob'}) MATCH (a)-->(b) RETURN a.name AS a") == [("alice",)]
    assert rows(u, "MATCH (n:User) MATCH (n:User) RETURN count(n) AS c") == [(4,)]
    assert rows(u, "MATCH (a), (b) WHERE a.age < b.age RETURN count(*) AS c") == [(6,)]


def test_optional_match(u):
    q = "MATCH (a:User) OPTIONAL MATCH (a)-[r:FRIEND]->(b) WHERE b.age > 30 RETURN a.name AS a, b.name AS b, r IS NULL AS none ORDER BY a"
    assert rows(u, q) == [("alice", None, True), ("bob", "charlie", False), ("charlie", None, True), ("dave", None, True)]
    assert rows(u, "OPTIONAL MATCH (n:Nobody) RETURN n.name AS n") == [(None,)]
    q = "MATCH (a:User) OPTIONAL MATCH (a)-[rs:FRIEND*1..2]->(b) RETURN a.name AS a, size(rs) AS n, b.name AS b ORDER BY a, n"
    assert rows(u, q) == [("alice", 1, "bob"), ("alice", 2, "charlie"), ("bob", 1, "charlie"), ("charlie", 0, None), ("dave", 0, None)]
    # the condition belongs to the match: rows without a match come back with nulls
    assert rows(u, "MATCH (a:User) OPTIONAL MATCH (a)-[:KNOWS]->(b) WHERE b IS NULL RETURN count(a) AS c") == [(4,)]
    assert rows(u, "MATCH (a:User) OPTIONAL MATCH (a)-[:KNOWS]->(b) WITH a, b WHERE b IS NULL RETURN count(a) AS c") == [(3,)]


def test_label_expressions(spark):
    g = make(spark, {"a": {"label": ["S", "I"]}, "b": {"label": ["S"]}, "c": {"label": "I"}}, [])
    ask = lambda t: [r[0] for r in rows(g, f"MATCH (n:{t}) RETURN id(n) AS k ORDER BY k")]
    assert ask("S:I") == ["a"] and ask("S|I") == ["a", "b", "c"] and ask("!S") == ["c"] and ask("S|!I") == ["a", "b"]
    assert rows(g, "MATCH (n) WHERE n:S RETURN count(n) AS c") == [(2,)]
    assert rows(g, "MATCH (n) RETURN labels(n) AS l ORDER BY id(n)") == [(["S", "I"],), (["S"],), (["I"],)]


def test_mixed_and_undirected_graphs(spark):
    people = {c: {"label": "P"} for c in "abcd"}
    g = make(spark, people, [("a", "b", {"type": "F"}), ("b", "c", {"type": "R", "undirected": True}), ("c", "d", {"type": "F"}), ("a", "d", {"type": "R", "undirected": True})], type="mixed")
    assert rows(g, "MATCH (x)-[:R]->(y) RETURN id(x) AS x, id(y) AS y ORDER BY x, y") == [("a", "d"), ("b", "c"), ("c", "b"), ("d", "a")]
    assert rows(g, "MATCH (x)-[:F]->(y) RETURN count(*) AS c") == [(2,)]
    assert rows(g, "MATCH (x)--(y) RETURN count(*) AS c") == [(8,)]
    g = make(spark, people, [("a", "b", {"type": "F"}), ("c", "c", {"type": "F"})], type="undirected")
    for arrow in ("-[:F]->", "<-[:F]-", "-[:F]-"):
        assert rows(g, f"MATCH (x){arrow}(y) RETURN id(x) AS x, id(y) AS y ORDER BY x") == [("a", "b"), ("b", "a"), ("c", "c")]


def test_variable_length(spark, u):
    g = chain(spark)
    assert rows(g, "MATCH (a {name: 'A'})-[:NEXT*2..4]->(b) RETURN b.name AS b ORDER BY b") == [("C",), ("D",), ("E",)]
    assert rows(g, "MATCH (a {name: 'C'})-[r:NEXT*0..1]->(b) RETURN b.name AS b, size(r) AS n ORDER BY b") == [("C", 0), ("D", 1)]
    assert rows(g, "MATCH (a {name: 'C'})-[*3]->(b) RETURN b.name AS b") == [("F",)]
    assert rows(g, "MATCH (b {name: 'C'})<-[:NEXT*..2]-(a) RETURN a.name AS a ORDER BY a") == [("A",), ("B",)]
    with pytest.warns(UserWarning, match="unbounded"):
        assert rows(g, "MATCH (a {name: 'A'})-[*]->(b) RETURN count(b) AS c") == [(10,)]  # depth is capped at 10
    assert rows(diamond(spark), "MATCH (a {name: 'a'})-[:L*]->(d {name: 'd'}) RETURN count(*) AS c") == [(3,)]
    assert rows(u, "MATCH (a {name: 'alice'})-[r:FRIEND*1..2]->(b) RETURN [x IN r | type(x)] AS t, reltype(r) AS u ORDER BY size(r)") == [(["FRIEND"], ["FRIEND"]), (["FRIEND", "FRIEND"], ["FRIEND", "FRIEND"])]


def test_variable_length_self_loop_ends_a_path(spark):
    g = make(spark, {"a": {"name": "a"}, "b": {"name": "b"}}, [("a", "a", {"type": "T"}), ("a", "b", {"type": "T"})])
    assert rows(g, "MATCH (x {name: 'a'})-[:T*1..3]->(y) RETURN y.name AS y ORDER BY y") == [("a",), ("b",)]


def test_path_guard(spark):
    g = chain(spark)
    tight = PropertyGraph(g.spark, g.nodes, g.edges, GraphConfig(max_paths=5, max_var_length_depth=6))
    with pytest.warns(UserWarning), pytest.raises(QueryError, match="more than 5 paths"):
        rows(tight, "MATCH (a)-[:NEXT*]->(b) RETURN count(*) AS c")


def test_limit_stops_following_paths(spark):
    nodes = {f"n{i}": {"id2": i} for i in range(8)}
    g = make(spark, nodes, [(f"n{i}", f"n{j}", {"type": "K"}) for i in range(8) for j in range(8) if i != j])
    assert len(rows(g, "MATCH (a)-[*1..]->(b) RETURN a.id2 AS a, b.id2 AS b LIMIT 10")) == 10
    assert len(rows(g, "MATCH (a {id2: 1})-[*1..]->(b) WHERE b.id2 > 3 RETURN a.id2 AS a, b.id2 AS b SKIP 2 LIMIT 20")) == 20  # 4 of one step, 24 of two
    few = rows(g, "MATCH (a {id2: 1})-[r:K*2..3]->(b {id2: 2}) RETURN size(r) AS n LIMIT 500")
    assert sorted(few) == [(2,)] * 6 + [(3,)] * 30


def test_paths_beyond_the_guard_are_cut_by_length(spark):
    g = chain(spark)
    cut = PropertyGraph(g.spark, g.nodes, g.edges, GraphConfig(max_paths=12, on_excess="stop"))
    with pytest.warns(UserWarning, match="more than 12 paths"):
        got = rows(cut, "MATCH (a)-[r:NEXT*]->(b) RETURN size(r) AS n, count(*) AS c ORDER BY n")
    steps = dict(got)
    assert sum(steps.values()) == 12 and min(steps) == 1 and steps[1] == dict(rows(g, "MATCH (a)-[r:NEXT*1..2]->(b) RETURN size(r) AS n, count(*) AS c"))[1]


def test_path_values(u):
    q = "MATCH p = (a {name: 'alice'})-[:FRIEND]->(b)-[:FRIEND]->(c) RETURN [n IN nodes(p) | n.name] AS ns, size(relationships(p)) AS r, length(p) AS l"
    assert rows(u, q) == [(["alice", "bob", "charlie"], 2, 2)]
    q = "MATCH p = (a {name: 'charlie'})<-[:FRIEND*2]-(c) RETURN [n IN nodes(p) | n.name] AS ns"
    assert rows(u, q) == [(["charlie", "bob", "alice"],)]
    assert rows(u, "MATCH (a {name: 'dave'}) OPTIONAL MATCH p = (a)-[:FRIEND]->(b) RETURN p IS NULL AS none") == [(True,)]


def test_shortest_paths(spark, u):
    q = "MATCH (a {name: 'a'}), (d {name: 'd'}) RETURN length(shortestPath((a)-[:L*]->(d))) AS l, size(allShortestPaths((a)-[:L*]->(d))) AS n, shortestPath((d)-[:L*]->(a)) IS NULL AS none, length(shortestPath((a)-[*]->(a))) AS own"
    assert rows(diamond(spark), q) == [(1, 1, True, 0)]
    g = make(spark, {c: {"name": c} for c in "abcd"}, [("a", "b", {}), ("b", "d", {}), ("a", "c", {}), ("c", "d", {})])
    q = "MATCH (a {name: 'a'}), (d {name: 'd'}) RETURN [p IN allShortestPaths((a)-[*]->(d)) | [n IN nodes(p) | n.name][1]] AS mid, length(shortestPath((a)-[*..1]->(d))) AS near"
    assert [(sorted(m), n) for m, n in rows(g, q)] == [(["b", "c"], None)]
    assert rows(u, "MATCH (a {name: 'dave'}), (b {name: 'charlie'}) RETURN length(shortestPath((a)-[*]-(b))) AS l, shortestPath((a)-[*]->(b)) AS p") == [(3, None)]


def test_pattern_values(u):
    q = "MATCH (n:User) RETURN n.name AS n, [(n)-[r]->(m) WHERE m.age > 26 | m.name] AS ms, size([(n)--(x) | r]) AS d ORDER BY n"
    with pytest.raises(QueryError):
        rows(u, q)
    q = "MATCH (n:User) RETURN n.name AS n, [(n)-[r]->(m) WHERE m.age > 26 | m.name] AS ms, size([(n)--(x) | x.name]) AS d ORDER BY n"
    assert rows(u, q) == [("alice", ["dave"], 2), ("bob", ["charlie"], 2), ("charlie", [], 1), ("dave", [], 1)]
    assert rows(u, "MATCH (n {name: 'bob'}) RETURN [(n)-[r]->(m) | size(r)] AS s, [(x)-->(y) | 1] AS unbound") == [([1], [])]
    assert rows(u, "MATCH (n:User) WITH n, count((n)-[]->()) AS c RETURN n.name AS n, c ORDER BY c DESC, n LIMIT 2") == [("alice", 2), ("bob", 1)]
    assert rows(u, "MATCH (n:User) WHERE (n)-[:FRIEND]->() AND NOT (n)<-[:FRIEND]-() RETURN n.name AS n") == [("alice",)]
    assert rows(u, "MATCH (n:User) WITH n, n.age AS least WHERE size([(n)--(m) WHERE m.age > least | 1]) = 0 RETURN n.name AS n ORDER BY n") == [("alice",), ("charlie",)]


def test_unknown_things_are_errors(u):
    with pytest.raises(QueryError):
        rows(u, "MATCH (n) RETURN m.name")
    with pytest.raises(QueryError):
        rows(u, "MATCH (n) RETURN nothing(n.name)")
    with pytest.raises(QueryError):
        rows(u, "MATCH (n) WHERE n.age > 'x' RETURN n")


def test_shortest_paths_read_only_tables_in_reach(spark, monkeypatch):
    from arcweft import table_graph
    from arcweft.operators import paths

    read, plain = [], paths._edges

    def edges(graph, rel, labels=None, bare=False):
        read.append(labels)
        return plain(graph, rel, labels, bare)

    monkeypatch.setattr(paths, "_edges", edges)
    table_graph(spark, "/root/testdata/sf0.001").cypher("MATCH (r:Region) MATCH (s:Supplier) RETURN size(allShortestPaths((s)-[*..3]->(r))) AS n")
    assert read == [{"Supplier"}, {"Nation"}, {"Region"}]


def test_measured_shortest_paths_read_no_relationships(spark, monkeypatch):
    from arcweft.operators import paths

    read, plain = [], paths._edges

    def edges(graph, rel, labels=None, bare=False):
        read.append((bare, labels and tuple(sorted(labels))))
        return plain(graph, rel, labels, bare)

    monkeypatch.setattr(paths, "_edges", edges)
    g = diamond(spark)
    both = "MATCH (a), (b) RETURN id(a), id(b), length(shortestPath((a)-[*]->(b))), size(allShortestPaths((a)-[*]->(b)))"
    listed = "MATCH (a), (b) WITH a, b, shortestPath((a)-[*]->(b)) AS p, allShortestPaths((a)-[*]->(b)) AS l RETURN id(a), id(b), length(p), size(l)"
    got = sorted(rows(g, both), key=str)
    assert {bare for bare, _ in read} == {True}
    assert got == sorted(rows(g, listed), key=str) and ("a", "d", 1, 1) in got and ("a", "a", 0, 1) in got and ("d", "a", None, 0) in got
    twice = make(spark, {c: {"label": "P"} for c in "abcd"}, [(x, y, {"type": "L"}) for x, y in ("ab", "ab", "ac", "bd", "cd")])
    assert rows(twice, "MATCH (a), (d) WHERE id(a) = 'a' AND id(d) = 'd' RETURN length(shortestPath((a)-[*]->(d))), size(allShortestPaths((a)-[*]->(d)))") == [(2, 3)]


def test_circles_are_joined_without_a_product(spark, monkeypatch):
    from arcweft import catalogue, table_graph
    from arcweft.plans.match import Matcher

    counts, plain = [], Matcher.extend

    def extend(self, *args, **more):
        out = plain(self, *args, **more)
        counts.append(out.df.count())
        return out

    monkeypatch.setattr(Matcher, "extend", extend)
    g = table_graph(spark, "/root/testdata/sf0.001")
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
    g.cypher(catalogue.ENTRIES["cyclic_pattern"].text)
    assert max(counts) <= lines


def test_circles_against_plain_python(spark):
    import random

    rng = random.Random(5)
    edges = [(rng.randrange(8), rng.randrange(8)) for _ in range(26)]
    names = [f"n{i}" for i in range(8)]
    g = make(spark, {v: {"label": "P", "k": i % 3} for i, v in enumerate(names)}, [(names[a], names[b], {"type": "L"}) for a, b in edges])
    triangles = [(a, b, d) for a, b in edges for c, d in edges if b == c for e, f in edges if (e, f) == (a, d)]
    assert rows(g, "MATCH (a)-->(b)-->(c), (a)-->(c) RETURN count(*)") == [(len(triangles),)]
    assert rows(g, "MATCH (a {k: 1})-->()-->(c:P), (a)-->(c) RETURN count(*)") == [(sum(a % 3 == 1 for a, _, _ in triangles),)]
    got = rows(g, "MATCH (a) WHERE a.k = 2 MATCH (a)-->(b)<--(c), (c)<--(a) RETURN id(a), id(b), id(c)")
    assert sorted(got) == sorted((names[a], names[d], names[b]) for a, b, d in triangles if a % 3 == 2)
    assert g.cypher("MATCH (a)-->()-->(c), (a)-->(c) RETURN *").columns == g.cypher("MATCH (a)-->()-->(c) RETURN *").columns
    assert rows(g, "MATCH (a)-->(a) RETURN count(*)") == [(sum(a == b for a, b in edges),)]


def test_short_paths_need_no_join_back(spark):
    from arcweft import catalogue, table_graph

    g = table_graph(spark, "/root/testdata/sf0.001")
    plan = g.cypher(catalogue.ENTRIES["varlen_simple_paths"].text)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 2 and "array" not in plan  # one for each step; neither the ends nor the start are joined again
    assert rows(g, "MATCH (r:Region)-[e*1..2]->(b:Nation) RETURN count(*), sum(size(e))") == [(0, 0)]
    assert rows(g, "MATCH (r:Region)<-[e*0..2]-(b:Region|Supplier) RETURN labelsOf(b)[0], count(*), sum(size(e)), count(b.suppkey)") in ([("Region", 5, 0, 0), ("Supplier", 10, 20, 10)], [("Supplier", 10, 20, 10), ("Region", 5, 0, 0)])


def test_path_counts_against_plain_python(spark):
    import random

    rng = random.Random(9)
    names = [f"n{i}" for i in range(7)]
    edges = [(rng.choice(names), rng.choice(names)) for _ in range(16)] + [("n1", "n1")]
    g = make(spark, {v: {"label": "PQ"[i % 2], "k": i} for i, v in enumerate(names)}, [(a, b, {"type": "L"}) for a, b in edges])
    both = edges + [(b, a) for a, b in edges if a != b]

    def count(ways, start, low, high):
        found, level = {}, [(start,)]
        for depth in range(high + 1):
            for p in level:
                if depth >= low:
                    found[p[-1]] = found.get(p[-1], 0) + 1
            level = [(*p, b) for p in level if len(p) < 2 or p[-1] != p[-2] for a, b in ways if a == p[-1] and (b == a or b not in p)]
        return found

    for ways, arrow in ((edges, "->"), (both, "-")):
        for low, high in ((0, 2), (1, 2), (2, 3), (1, 4)):
            want = sorted((v, w, n) for v in names for w, n in count(ways, v, low, high).items())
            assert sorted(rows(g, f"MATCH (a)-[*{low}..{high}]{arrow}(b) RETURN id(a), id(b), count(*)")) == want
        want = sorted((v, sum(n for w, n in count(ways, v, 1, 2).items() if int(w[1]) % 2)) for v in names if not int(v[1]) % 2)
        assert sorted(rows(g, f"MATCH (a:P) WITH a OPTIONAL MATCH (a)-[*1..2]{arrow}(b:Q) RETURN id(a), count(b)")) == want
        assert [r for r in sorted(rows(g, f"MATCH (a:P)-[*1..2]{arrow}(b:Q) RETURN id(a), count(*)")) if r[1]] == [w for w in want if w[1]]


def test_products_are_measured_without_their_pairs(spark, monkeypatch):
    import random

    from arcweft import table_graph
    from arcweft.operators import paths

    listed = "WITH a, b, shortestPath({0}) AS p, allShortestPaths({0}) AS l RETURN id(a), id(b), length(p), size(l)"
    direct = "RETURN id(a), id(b), length(shortestPath({0})), size(allShortestPaths({0}))"
    rng = random.Random(3)
    names = [f"n{i}" for i in range(14)]
    pairs = [(*rng.sample(names, 2), {"type": rng.choice("LM"), "w": rng.randint(0, 1), **({"undirected": True} if rng.random() < 0.2 else {})}) for _ in range(28)]
    g = make(spark, {n: {"label": rng.choice("PQ"), "few": int(n == "n3")} for n in names}, pairs)
    monkeypatch.setattr(paths, "BUCKET", 2)
    cases = [("MATCH (a), (b) ", "(a)-[:L*2..3]-(b)"), ("MATCH (b {few: 1}) MATCH (a) ", "(a)-[*..4]->(b)"), ("UNWIND [1, 1] AS x MATCH (b:P) MATCH (a:Q) ", "(a)<-[*0..2 {w: 1}]-(b)")]
    wanted = [sorted(rows(g, m + listed.format(p)), key=str) for m, p in cases]
    monkeypatch.setattr(paths, "_pairs", lambda *args: pytest.fail("all pairs were written"))
    assert [sorted(rows(g, m + direct.format(p)), key=str) for m, p in cases] == wanted
    text = "MATCH (r:Region) MATCH (c:Customer) RETURN c.custkey AS k, r.name AS r, length(shortestPath((c)-[:IN_NATION|IN_REGION*..3]->(r))) AS n"
    assert table_graph(spark, "/root/testdata/sf0.001").cypher(text).where("n = 2").count() == 150


def test_products_are_not_joined_with_what_a_search_finds(spark):
    from arcweft import table_graph

    text = "MATCH (c:Customer) MATCH (s:Supplier) RETURN c.custkey AS c, s.suppkey AS s, size(allShortestPaths((c)-[:PLACED|SUPPLIED_BY*..2]->(s))) AS n"
    df = table_graph(spark, "/root/testdata/sf0.001").cypher(text)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join Inner" if "Join Inner" in plan else "Join Cross") < plan.index("Join LeftOuter")  # the product is above the join
    assert df.count() == 150 * 10 and df.selectExpr("sum(n)").first()[0] == 6000


def test_levels_of_few_rows_are_sent_to_stored_keys(spark, monkeypatch):
    from arcweft import table_graph
    from arcweft.graph import EdgeTable, NodeTable, PropertyGraph
    from arcweft.operators import paths

    plans, plain = [], paths.cut_lineage
    monkeypatch.setattr(paths, "cut_lineage", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or plain(df))
    text = "MATCH (c:Customer) MATCH (s:Supplier) RETURN c.custkey AS c, s.suppkey AS s, size(allShortestPaths((c)-[:PLACED|SUPPLIED_BY*..2]->(s))) AS n"
    g = table_graph(spark, "/root/testdata/sf0.001")
    got, plan = sorted(rows(g, text)), g.cypher(text)._jdf.queryExecution().optimizedPlan().toString()
    steps = [p for p in plans if "l_suppkey" in p and "Join" in p]
    assert steps and all("strategy=broadcast" in p for p in steps)
    assert "Supplier:" not in plan  # combinations look up keys, not texts
    # keys that are texts of other numbers, tables that hold the same keys in another type
    a = spark.createDataFrame([("1",), ("01",), ("B:1",), ("-7",)], "k string")
    b = spark.createDataFrame([(1,), (2,), (-7,), (None,)], "k long")
    kinds = (("X", [("1", 1), ("01", 2), ("B:1", -7), ("-7", None)], "s string, t long", "A", "B"), ("Y", [(1, 1), (2, -7)], "s long, t int", "B", "A"), ("Z", [(1, "01"), (-7, "-7"), (None, "1")], "s int, t string", "A", "A"))
    odd = PropertyGraph(spark, (NodeTable(a, "k", {"k": "k"}, label="A"), NodeTable(b, "k", {"k": "k"}, label="B")), tuple(EdgeTable(spark.createDataFrame(r, s), "s", "t", {}, type=k, source_label=x, target_label=y) for k, r, s, x, y in kinds))
    text = "MATCH (a:A), (b:B) RETURN a.k, b.k, size(allShortestPaths((a)-[*..2]-(b)))"
    found = sorted(rows(odd, text), key=str)
    monkeypatch.setattr(paths, "NEAR", -1)
    assert sorted(rows(odd, text), key=str) == found
    assert ("01", 2, 1) in found and ("1", 2, 0) not in found and ("B:1", -7, 1) in found and ("B:1", 1, 0) in found


def test_paths_that_are_only_counted_are_not_made(spark, monkeypatch):
    from arcweft import catalogue, table_graph
    from arcweft.graph import EdgeTable, NodeTable, PropertyGraph
    from arcweft.operators import paths

    def listed(graph, pattern, key):
        """By start, how many paths there are, from a row for each of them."""
        found = {}
        for (k,) in rows(graph, f"MATCH {pattern} RETURN {key}"):
            found[k] = found.get(k, 0) + 1
        return found

    g = table_graph(spark, "/root/testdata/sf0.001")
    counted = ["(a:Supplier)-[:IN_NATION*1..2]-(b:Customer)", "(a:Region)<-[e*0..3]-(b)", "(a:Customer)-[*0..2]->(b:Customer|Order)", "(a:Customer)-[*2..3]->(b:!Part)", "(a:Nation)<-[*2]-()", "(a:Nation)-[*0..1]->(b:Nation)"]
    others = ["(a:Supplier)-[:IN_NATION*1..2]-(b:Supplier)", "(a:Region)-[*2..3]-(b:Region)", "(a:Region)-[*1..2]-(b:Nation)"]  # a label comes again
    key = {"Supplier": "a.suppkey", "Region": "a.regionkey", "Customer": "a.custkey", "Nation": "a.nationkey"}
    key = {p: key[p[3 : p.index(")")]] for p in counted + others}
    wanted = {p: listed(g, p, key[p]) for p in counted + others}
    for p in others:
        assert dict(rows(g, f"MATCH {p} RETURN {key[p]}, count(*)")) == wanted[p]
    below = rows(g, "MATCH (a:Supplier)-[:IN_NATION*1..2]-(b:Customer) WHERE a.suppkey = 3 WITH a, count(b) AS n RETURN a.suppkey, n")  # picked out: listed
    summed = rows(g, "MATCH (a:Supplier)-[:IN_NATION*1..2]-(b:Customer) RETURN sum(a.suppkey), count(a.acctbal)")  # rows of their own
    # keys of several types, edges without an end, edges to the node itself and to itself by another table, nodes without edges
    a, b = spark.createDataFrame([("1",), ("01",), ("7",)], "k string"), spark.createDataFrame([(1,), (2,), (7,), (None,)], "k long")
    kinds = (("X", [("1", 1), ("1", 1), ("01", 2), ("7", None)], "s string, t long", "A", "B"), ("Y", [(1, 2), (1, 1), (2, 2), (None, 1)], "s long, t int", "B", "B"))
    odd = PropertyGraph(spark, (NodeTable(a, "k", {"k": "k"}, label="A"), NodeTable(b, "k", {"k": "k"}, label="B")), tuple(EdgeTable(spark.createDataFrame(r, s), "s", "t", {}, type=k, source_label=x, target_label=y) for k, r, s, x, y in kinds))
    steps = ["(a:A)-[*1]->(b)", "(a:A)-[:X*0..1]->(b)", "(a:A)-[*1..2]->(b:B)", "(a:B)-[*1]->(b)", "(a:B)-[*0..1]-(b)", "(a:B)<-[*1..3]-(b)"]
    found = [listed(odd, p, "a.k") for p in steps]
    assert found[:2] == [{"1": 2, "01": 1}, {"1": 3, "01": 2, "7": 1}] and found[2] == {"1": 6, "01": 2} and found[3] == {1: 2, 2: 1}
    assert [dict(rows(odd, f"MATCH {p} RETURN a.k, count(b)")) for p in steps] == found
    assert rows(odd, "MATCH (a:A)-[:X*1..2]->(b:A) RETURN count(*), min(a.k)") == [(0, None)]

    monkeypatch.setattr(paths, "expand", lambda *args, **more: pytest.fail("paths were made"))
    for p in counted:
        b = "b" if "b" in p else "*"
        assert dict(rows(g, f"MATCH {p} RETURN {key[p]}, count({b})")) == wanted[p]
    for p in counted[1:3]:
        assert rows(g, f"MATCH {p} RETURN count(*) AS n, count({key[p]}), count(DISTINCT {key[p]}), max({key[p]})") == [(sum(wanted[p].values()),) * 2 + (len(wanted[p]), max(wanted[p]))]
    p, entry = counted[0], g.cypher(catalogue.ENTRIES["varlen_simple_paths"].text)
    assert dict(tuple(r) for r in entry.collect()) == wanted[p] and [t for _, t in entry.dtypes] == ["bigint", "bigint"]
    assert below == [(3, wanted[p][3])] and summed == [(sum(k * n for k, n in wanted[p].items()), sum(wanted[p].values()))]
    some = sorted((n, k) for k, n in wanted[p].items() if k > 4)
    assert rows(g, f"MATCH {p} WHERE a.suppkey > 4 WITH a, count(b) AS n ORDER BY n DESC, a.suppkey DESC LIMIT 3 WHERE n > 1 RETURN n, a.suppkey") == some[::-1][:3]
    assert g.cypher(f"MATCH {p} RETURN a.suppkey, count(b)").columns == ["suppkey", "COUNT(b)"]
