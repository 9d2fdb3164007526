"""Projection, conditions, aggregation, ordering, unions and subqueries."""

import pytest
from graphs import make, rows, users


@pytest.fixture(scope="module")
def u(spark):
    return users(spark)


@pytest.fixture(scope="module")
def items(spark):
    return make(spark, {"a": {"label": "Item", "value": 10}, "b": {"label": "Item", "value": None}, "c": {"label": "Item"}, "d": {"label": "Item", "value": 20}, "e": {"label": "Item", "value": 10}}, [])


def test_default_names(u):
    df = u.cypher("MATCH (a {name: 'alice'})-[:KNOWS]->(b) RETURN a.name, b.name, a.age, count(*), sum(b.age), toUpper(a.name)")
    assert df.columns == ["a.name", "b.name", "age", "count(*)", "SUM(b.age)", "toupper(name)"]


def test_null_logic(items):
    assert rows(items, "MATCH (n:Item) WHERE NOT (n.value = 10) RETURN id(n) AS k ORDER BY k") == [("b",), ("c",), ("d",)]
    assert rows(items, "MATCH (n:Item) WHERE n.value <> 10 RETURN id(n) AS k") == [("d",)]
    assert rows(items, "MATCH (n:Item) WHERE n.value IS NULL RETURN count(*) AS c") == [(2,)]
    assert rows(items, "MATCH (n:Item) WHERE EXISTS(n.value) XOR n.value = 20 RETURN count(*) AS c") == [(2,)]
    assert rows(items, "MATCH (n:Item) WHERE n.value IN [10, null] RETURN count(*) AS c") == [(2,)]


def test_predicates(u):
    assert rows(u, "MATCH (n) WHERE n.name STARTS WITH 'a' OR n.name ENDS WITH 'b' OR n.name CONTAINS 'av' RETURN count(*) AS c") == [(3,)]
    assert rows(u, "MATCH (n) WHERE 25 < n.age <= 30 RETURN count(*) AS c") == [(2,)]
    assert rows(u, "MATCH (n) WHERE n.name = 1 RETURN count(*) AS c") == [(0,)]
    assert rows(u, "MATCH (n) WHERE 'a' IN n.name RETURN count(*) AS c") == [(3,)]
    assert rows(u, "MATCH (n) WHERE n = {name: 'bob', age: 25} RETURN id(n) AS k") == [("bob",)]
    assert rows(u, "RETURN {a: 1, b: {c: 2}} = {b: {c: 2}} AS x, [1, {a: 1}] IS NULL AS y, {a: 1} = {} AS z") == [(True, False, True)]


def test_aggregates(items):
    q = "MATCH (n:Item) RETURN count(*) AS a, count(n.value) AS b, count(DISTINCT n.value) AS c, sum(n.value) AS s, avg(n.value) AS v, min(n.value) AS lo, max(n.value) AS hi, sum(DISTINCT n.value) AS sd, avg(DISTINCT n.value) AS ad"
    assert rows(items, q) == [(5, 3, 2, 40, 40 / 3, 10, 20, 30, 15.0)]
    (got,) = rows(items, "MATCH (n:Item) RETURN collect(n.value) AS all, collect(DISTINCT n.value) AS some, size(collect(n)) * 2 AS twice")
    assert sorted(got[0], key=str) == [10, 10, 20, None, None] and sorted(got[1], key=str) == [10, 20, None] and got[2] == 10
    assert rows(items, "MATCH (n:Nobody) RETURN count(n) AS c, sum(n.value) AS s, avg(n.value) AS a, max(n.value) AS m, collect(n.value) AS l") == [(0, 0, None, None, [])]
    assert rows(items, "MATCH (n:Nobody) RETURN n.value AS k, count(n) AS c") == []
    assert rows(items, "MATCH (n:Item) RETURN n.value AS v, count(*) AS c ORDER BY c DESC, v") == [(10, 2), (None, 2), (20, 1)]
    assert rows(items, "MATCH (n:Item) WITH n.value AS v, count(*) AS c WHERE c > 1 AND v IS NOT NULL RETURN v, c + v AS x") == [(10, 12)]


def test_ordering(items, u):
    assert rows(items, "MATCH (n:Item) RETURN n.value AS v ORDER BY v") == [(10,), (10,), (20,), (None,), (None,)]
    assert rows(items, "MATCH (n:Item) RETURN n.value AS v ORDER BY v DESC") == [(None,), (None,), (20,), (10,), (10,)]
    assert rows(items, "MATCH (n:Item) RETURN n.value AS v ORDER BY v NULLS FIRST LIMIT 3") == [(None,), (None,), (10,)]
    assert rows(items, "MATCH (n:Item) RETURN DISTINCT n.value AS v ORDER BY v DESC NULLS LAST SKIP 1 LIMIT 1") == [(10,)]
    assert rows(u, "MATCH (n) RETURN n.age > 28 AS old ORDER BY old, n.name") == [(True,), (True,), (False,), (False,)]
    assert rows(u, "MATCH (n) RETURN n.name AS x ORDER BY n.age DESC LIMIT 1") == [("charlie",)]
    assert rows(u, "UNWIND ['2023-01-02T00:00:00+05:00', '2023-01-01T22:00:00Z', 'x'] AS t WITH datetime(t) AS d RETURN d ORDER BY d") == [("2023-01-01T19:00:00.000Z",), ("2023-01-01T22:00:00.000Z",), (None,)]


def test_with_and_stars(u):
    assert rows(u, "MATCH (n {name: 'bob'}) WITH * RETURN n.age AS a") == [(25,)]
    assert u.cypher("MATCH (a)-[r:KNOWS]->(b) RETURN *").columns == ["a", "r", "b"]
    assert rows(u, "MATCH (n) WITH n.age AS a RETURN count(*) AS c") == [(4,)]
    assert rows(u, "UNWIND [1, 1, 2] AS x WITH DISTINCT x RETURN count(*) AS c") == [(2,)]
    assert rows(u, "UNWIND [1, 1, 2] AS x WITH x RETURN count(*) AS c") == [(3,)]
    assert rows(u, "MATCH (n) WITH n ORDER BY n.age LIMIT 2 MATCH (n)-->(m) RETURN n.name AS n, m.name AS m") == [("bob", "charlie")]
    assert rows(u, "MATCH (n) WITH n AS m WHERE m.age = 25 RETURN m.name AS x") == [("bob",)]


def test_limit_before_order(u):
    assert rows(u, "MATCH (n) RETURN n.name AS n LIMIT 2 ORDER BY n DESC") == [("dave",), ("charlie",)]


def test_unwind(u):
    assert rows(u, "UNWIND [1, 2, 3] AS x WHERE x <> 2 RETURN x") == [(1,), (3,)]
    assert rows(u, "UNWIND null AS x RETURN x") == [] and rows(u, "UNWIND 'ab' AS x RETURN x") == [("a",), ("b",)]
    assert rows(u, "UNWIND 5 AS x RETURN x") == [(5,)]
    assert rows(u, "MATCH (n) WITH collect(n) AS ns UNWIND ns AS n RETURN n.name AS x ORDER BY x LIMIT 1") == [("alice",)]


def test_unions(u):
    assert rows(u, "RETURN 1 AS a UNION ALL RETURN 1 AS a UNION RETURN 2 AS a ORDER BY a") == [(1,), (2,)]
    q = "MATCH (n) RETURN n.name AS x ORDER BY n.age DESC LIMIT 1 UNION ALL MATCH (n) RETURN n.name AS x ORDER BY n.age LIMIT 1"
    assert sorted(rows(u, q)) == [("bob",), ("charlie",)]
    df = u.cypher("RETURN 1 AS a, 'x' AS b UNION ALL RETURN 2.5 AS a, true AS c")
    assert df.columns == ["a", "b", "c"] and sorted(tuple(r) for r in df.collect()) == [(1.0, "x", None), (2.5, None, True)]
    assert rows(u, "MATCH (n) RETURN n.name AS n UNION ALL MATCH (n) RETURN n.name AS n ORDER BY n DESC SKIP 1 LIMIT 2") == [("dave",), ("charlie",)]


def test_subqueries(u):
    q = "MATCH (a) CALL { MATCH (a)-->(b) RETURN b.name AS y } RETURN a.name AS a, y ORDER BY y"
    assert rows(u, q) == [("alice", "bob"), ("bob", "charlie"), ("alice", "dave")]
    q = "MATCH (a) CALL { WITH a MATCH (a)-->(b) RETURN count(b) AS c, collect(b.name) AS l, max(b.age) AS m } RETURN a.name AS a, c, size(l) AS n, m ORDER BY a"
    assert rows(u, q) == [("alice", 2, 2, 28), ("bob", 1, 1, 35), ("charlie", 0, 0, None), ("dave", 0, 0, None)]
    q = "MATCH (a) CALL { MATCH (b) WHERE b.age < a.age RETURN b.name AS y, b.age AS g ORDER BY g DESC LIMIT 1 } YIELD y WHERE y <> 'bob' RETURN a.name AS a, y ORDER BY a"
    assert rows(u, q) == [("alice", "dave"), ("charlie", "alice")]
    q = "MATCH (a {name: 'alice'}) CALL { MATCH (a)-->(b) RETURN b.name AS y UNION ALL RETURN 'z' AS y UNION ALL MATCH (a) RETURN a.name AS y } RETURN y ORDER BY y"
    assert rows(u, q) == [("alice",), ("bob",), ("dave",), ("z",)]
    q = "MATCH (a {name: 'alice'}) CALL { MATCH (a)-->(b) CALL { MATCH (b)-->(c) RETURN count(c) AS k } RETURN sum(k) AS t } RETURN t"
    assert rows(u, q) == [(1,)]
    assert rows(u, "UNWIND [1, 1] AS x CALL { UNWIND [1, 2] AS y RETURN sum(y) AS s } RETURN x, s") == [(1, 3), (1, 3)]
    assert rows(u, "UNWIND [1, 2] AS x CALL { WITH x RETURN DISTINCT x * 2 AS y } RETURN y ORDER BY y") == [(2,), (4,)]
