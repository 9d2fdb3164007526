"""Writes: each gives a new graph, and later clauses see it."""

import pytest
from graphs import rows, users

from arcweft import QueryError


@pytest.fixture(scope="module")
def u(spark):
    return users(spark)


def after(graph, write, read):
    _, new = graph.execute(write)
    return [tuple(r) for r in new.cypher(read).collect()]


def test_create(u):
    read = "MATCH (a)-[r:KNOWS]->(b) WHERE r.since = 2020 RETURN a.name AS a, b.name AS b, labels(b) AS l"
    assert after(u, "CREATE (a:User:Admin {name: 'eve'})-[:KNOWS {since: 2020}]->(b:User {name: 'zed'})", read) == [("eve", "zed", ["User"])]
    assert after(u, "MATCH (a {name: 'dave'}) CREATE (a)<-[:LIKES]-(x:New {name: a.name + '2'})", "MATCH (x:New)-[:LIKES]->(a) RETURN x.name AS x, a.name AS a") == [("dave2", "dave")]
    assert after(u, "CREATE (:X {k: 1}), (:X {k: 2})", "MATCH (x:X) RETURN sum(x.k) AS s") == [(3,)]
    assert after(u, "UNWIND [1, 2, 3] AS i CREATE (:N {i: i * 10})", "MATCH (n:N) RETURN n.i AS i ORDER BY i") == [(10,), (20,), (30,)]
    assert rows(u, "CREATE (a:T {x: 1}) RETURN a.x AS x, labels(a) AS l") == [(1, ["T"])]
    assert rows(u, "MATCH (n) RETURN count(n) AS c") == [(4,)]  # the graph itself never changes


def test_set_and_remove(u):
    assert rows(u, "MATCH (a {name: 'bob'}) SET a.age = a.age + 1, a.x = 'new', a:Old RETURN a.age AS age, a.x AS x, labels(a) AS l") == [(26, "new", ["User", "Old"])]
    assert after(u, "MATCH (a)-[r:FRIEND]->() SET r.w = 5", "MATCH ()-[r]->() RETURN type(r) AS t, r.w AS w ORDER BY t, w") == [("FRIEND", 5), ("FRIEND", 5), ("KNOWS", None)]
    assert after(u, "MATCH (a:User) REMOVE a.age, a:User", "MATCH (a) RETURN count(a.age) AS c, max(size(labels(a))) AS l") == [(0, 0)]
    assert after(u, "MATCH (a {name: 'bob'}) SET a.age = 'old'", "MATCH (a) RETURN a.age AS a ORDER BY a") == [("28",), ("30",), ("35",), ("old",)]
    with pytest.raises(QueryError):
        rows(u, "UNWIND [1] AS x SET x.y = 1")


def test_delete(u):
    assert after(u, "MATCH (a {name: 'bob'}) DETACH DELETE a", "MATCH (a) OPTIONAL MATCH (a)-[r]->(b) RETURN a.name AS a, b.name AS b ORDER BY a") == [("alice", "dave"), ("charlie", None), ("dave", None)]
    assert after(u, "MATCH ()-[r:FRIEND]->() DELETE r", "MATCH ()-[r]->() RETURN type(r) AS t") == [("KNOWS",)]
    assert after(u, "MATCH (a {name: 'alice'})-[rs:FRIEND*2]->() DELETE rs", "MATCH ()-[r]->() RETURN count(r) AS c") == [(1,)]


def test_merge(u):
    assert after(u, "MERGE (a:User {name: 'alice'}) ON MATCH SET a.seen = true ON CREATE SET a.made = true", "MATCH (a:User) WHERE a.seen RETURN a.name AS n") == [("alice",)]
    made = "UNWIND ['q', 'q', 'bob'] AS n MERGE (a:User {name: n}) ON CREATE SET a.made = 1 RETURN n, a.made AS m ORDER BY n"
    assert rows(u, made) == [("bob", None), ("q", 1), ("q", 1)]
    chain = "MATCH (a {name: 'alice'}), (c {name: 'charlie'}) MERGE (a)-[r:KNOWS]->(c) ON CREATE SET r.fresh = true"
    assert after(u, chain, "MATCH ({name: 'alice'})-[r:KNOWS]->(b) RETURN b.name AS b, r.fresh AS f ORDER BY b") == [("charlie", True), ("dave", None)]
    assert after(u, "MATCH (a {name: 'alice'}) MERGE (a)-[:KNOWS]->(d {name: 'dave'})", "MATCH ()-[r:KNOWS]->() RETURN count(r) AS c") == [(1,)]
    assert after(u, "MERGE (x:City {name: 'Rome'})-[:IN]->(y:Land {name: 'Italy'})", "MATCH (x:City)-[:IN]->(y:Land) RETURN x.name AS x, y.name AS y") == [("Rome", "Italy")]
    assert after(u, "MERGE (a:User {name: 'alice'}) WHERE a.age > 99", "MATCH (a:User {name: 'alice'}) RETURN count(a) AS c") == [(2,)]


def test_foreach(u):
    assert after(u, "MATCH (a:User) WITH collect(a) AS l FOREACH (x IN l WHERE x.age > 28 | SET x.big = true SET x:Big)", "MATCH (a:Big) RETURN count(a.big) AS c") == [(2,)]
    assert after(u, "MATCH (a {name: 'bob'}) FOREACH (i IN [1] | SET a.z = i, SET a:T, CREATE (:K2 {i: i}))", "MATCH (a:T), (k:K2) RETURN a.z + k.i AS s") == [(2,)]
    assert after(u, "FOREACH (i IN [1, 2] | CREATE (:K {i: i}))", "MATCH (k:K) RETURN sum(k.i) AS s") == [(3,)]
    assert after(u, "MATCH p = ({name: 'alice'})-[:FRIEND*2]->() FOREACH (n IN nodes(p) | SET n.mark = 1)", "MATCH (n) WHERE n.mark = 1 RETURN n.name AS n ORDER BY n") == [("alice",), ("bob",), ("charlie",)]


def test_writes_in_subqueries_and_visibility(u):
    assert rows(u, "MATCH (a {name: 'bob'}) SET a.age = 1 WITH a MATCH (b) WHERE b.age < 10 RETURN b.name AS n") == [("bob",)]
    assert rows(u, "CREATE (:Z) WITH count(*) AS c MATCH (z:Z) RETURN c, count(z) AS n") == [(1, 1)]
    assert after(u, "MATCH (a:User) CALL { WITH a CREATE (:Copy {name: a.name}) }", "MATCH (c:Copy) RETURN count(c) AS c") == [(4,)]


def test_foreach_elements_carry_no_list(spark, monkeypatch):
    from arcweft.operators import writes

    seen, plain = [], writes.set_values

    def set_values(planner, frame, items, remove=False):
        seen.append([f.name for f in frame.df.schema.fields if f.dataType.typeName() == "array" and f.dataType.elementType.typeName() == "struct"])
        return plain(planner, frame, items, remove)

    monkeypatch.setattr(writes, "set_values", set_values)
    got = rows(users(spark), "MATCH (n:User) WITH collect(n) AS all, 2 AS two FOREACH (x IN all WHERE x.age > 26 | SET x.twice = x.age * two) WITH size(all) AS k MATCH (n:User) RETURN k, n.name, n.twice")
    assert sorted(got, key=str) == [(4, "alice", 60), (4, "bob", None), (4, "charlie", 70), (4, "dave", 56)]
    assert seen == [[]]
