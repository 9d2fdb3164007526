"""Sources, sinks, validation, explain, cache, command line, streaming."""

import io
import json

import pytest
from graphs import rows, users
from pyspark.sql import functions as F

import arcweft
from arcweft import EdgeTable, GraphBuilder, GraphConfig, GraphError, NodeTable, PropertyGraph, QuerySyntaxError, cli, explain, load_graph, register_format, validate
from arcweft.sources.cache import GraphCache
from arcweft.streaming.edges import windowed_counts, with_streamed_edges

DATA = {
    "options": {"type": "directed", "multi": False},
    "nodes": [{"key": "a", "attributes": {"label": "User", "name": "Ann", "age": 3}}, {"key": "b", "attributes": {"label": ["User", "Boss"], "name": "Bob", "score": 1.5}}],
    "edges": [{"key": "k1", "source": "a", "target": "b", "attributes": {"type": "KNOWS", "since": 2020}}],
}


def test_json_file(spark, tmp_path):
    data = json.loads(json.dumps(DATA))
    data["nodes"][1]["attributes"]["label"] = "User"
    path = tmp_path / "g.json"
    path.write_text(json.dumps(data))
    g = load_graph(spark, str(path))
    assert rows(g, "MATCH (x:User)-[r:KNOWS]->(y) RETURN id(x) AS x, y.name AS y, r.since AS s, id(r) AS r") == [("a", "Bob", 2020, "k1")]


def test_dict_and_custom_properties(spark):
    g = PropertyGraph.from_json(spark, DATA)
    assert rows(g, "MATCH (x:Boss) RETURN x.name AS n, x.score AS s") == [("Bob", 1.5)]
    other = {"nodes": [{"key": "a", "attributes": {"kind": "K"}}, {"key": "b", "attributes": {"kind": "K"}}], "edges": [{"source": "a", "target": "b", "attributes": {"rel": "R"}}]}
    g = PropertyGraph.from_json(spark, other, GraphConfig(label_property="kind", edge_type_property="rel"))
    assert rows(g, "MATCH (x:K)-[:R]->(y:K) RETURN id(y) AS y") == [("b",)]
    assert arcweft.execute_query(DATA, "MATCH (n) RETURN count(n) AS c", spark).first()[0] == 2


def broken(**change):
    data = json.loads(json.dumps(DATA))
    data.update(change)
    return data


@pytest.mark.parametrize(
    "data",
    [
        [], {"nodes": []}, broken(options={"type": "odd"}), broken(nodes=[{"key": ""}]), broken(nodes=[{"key": "a"}, {"key": "a"}]), broken(nodes=[{"key": "a", "attributes": 1}]),
        broken(edges=[{"source": "a", "target": "z"}]), broken(edges=[{"source": "a"}]), broken(edges=[{"source": "a", "target": "b"}, {"source": "a", "target": "b"}]),
        broken(options={"allowSelfLoops": False}, edges=[{"source": "a", "target": "a"}]),
    ],
)
def test_validation_errors(data):
    with pytest.raises(GraphError):
        validate(data)


def test_validation_warnings():
    assert len(validate(broken(edges=[{"source": "a", "target": "b", "undirected": True}]))) == 1
    assert len(validate(broken(options={"multi": True}, edges=[{"key": "k", "source": "a", "target": "b"}, {"key": "k", "source": "a", "target": "b"}]))) == 1


def test_builder_and_frames(spark):
    b = GraphBuilder().add_node("x", label="A", v=1).add_node("y", label="B").add_edge("x", "y", type="T")
    assert rows(b.build(spark), "MATCH (a:A)-[:T]->(b:B) RETURN a.v AS v") == [(1,)]
    with pytest.raises(GraphError):
        b.add_edge("x", "nobody")
    nodes = spark.createDataFrame([("1", "P"), ("2", "P")], "id string, label string")
    edges = spark.createDataFrame([("1", "2", "T")], "source string, target string, type string")
    g = PropertyGraph.from_frames(nodes, edges)
    assert rows(g, "MATCH (a:P)-[r:T]->(b) RETURN id(b) AS b") == [("2",)]
    lost = PropertyGraph.from_frames(nodes, spark.createDataFrame([("1", "9", "T")], "source string, target string, type string"))
    with pytest.raises(GraphError):
        lost.check()


def test_typed_tables_join_stored_keys(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k long, name string")
    e = spark.createDataFrame([(1, 2, 5)], "s long, t long, w long")
    g = PropertyGraph(spark, (NodeTable(a, "k", {"name": "name"}, label="A"),), (EdgeTable(e, "s", "t", {"w": "w"}, type="T", source_label="A", target_label="A"),))
    assert rows(g, "MATCH (a:A)-[r:T]->(b:A) RETURN a.name AS a, b.name AS b, r.w AS w, id(a) AS i") == [("x", "y", 5, "A:1")]
    plan = arcweft.explain_plan(g, "MATCH (a:A)-[:T]->(b:A) RETURN a.name AS n, count(b) AS c")
    assert plan.count("Join") and "concat" not in plan.split("== Final Plan ==")[0].split("(1)")[0]
    assert g.cypher("MATCH (a:A)-[:T]->(b:A) RETURN count(b) AS c")._jdf.queryExecution().optimizedPlan().toString().count("Join") == 0


def test_tables_and_memory(spark, tmp_path):
    g = users(spark)
    g.write_tables(str(tmp_path / "g"))
    again = PropertyGraph.read_tables(spark, str(tmp_path / "g"))
    q = "MATCH (a:User)-[r:FRIEND]->(b) RETURN a.name AS a, b.age AS b ORDER BY a"
    assert rows(again, q) == rows(g.indexed(), q) == rows(g, q) == [("alice", 25), ("bob", 35)]


def test_argument_checks():
    from arcweft.functions import arguments as need

    assert need.number("f", 3) == 3 and need.string("f", None) is None and need.numbers("f", [1, None, 2.5]) == [1, 2.5] and need.arity("f", [1], 1, 2) == [1]
    for bad in (lambda: need.number("f", "x"), lambda: need.number("f", True), lambda: need.string("f", None, False), lambda: need.array("f", 1), lambda: need.arity("f", [], 1), lambda: need.boolean("f", 1)):
        with pytest.raises(arcweft.FunctionError):
            bad()


def test_csv(spark, tmp_path):
    g = users(spark)
    p = tmp_path / "p.csv"
    p.write_text('﻿name, age ,city\nAnn,30,"Paris, ""FR"""\nBob, 25 ,"two\nlines"\nCid,\n')
    assert rows(g, f"LOAD CSV WITH HEADERS FROM '{p}' AS r RETURN r.name AS n, r.age AS a, r.city AS c") == [("Ann", "30", 'Paris, "FR"'), ("Bob", "25", "two\nlines"), ("Cid", "", "")]
    t = tmp_path / "p.tsv"
    t.write_text("a|'x|y'\nb|z\n")
    assert rows(g, f"LOAD CSV FROM '{t}' AS r FIELDS TERMINATED BY '|' OPTIONALLY ENCLOSED BY \"'\" RETURN r[0] AS a, r[1] AS b, size(r) AS n") == [("a", "x|y", 2), ("b", "z", 2)]
    assert rows(g, f"LOAD CSV WITH HEADERS FROM '{p}' AS r MATCH (u:User) WHERE u.age = toInteger(r.age) RETURN r.name AS r, u.name AS u ORDER BY r") == [("Ann", "alice"), ("Bob", "bob")]
    empty = tmp_path / "h.csv"
    empty.write_text("a,b\n")
    assert rows(g, f"LOAD CSV WITH HEADERS FROM '{empty}' AS r RETURN count(r) AS c") == [(0,)]


def test_explain():
    got = explain("MATCH (a:User)-[r:KNOWS*1..2]->(b) WHERE a.x > 1 WITH a, count(b) AS c WHERE c > 1 RETURN a.name, c ORDER BY c DESC LIMIT 3")
    assert [s["type"] for s in got["stages"]] == ["MATCH", "WITH", "RETURN"] and got["finalVariables"] == ["name", "c"]
    assert got["stages"][0]["details"]["patterns"] == ["(a:User)-[r:KNOWS*1..2]->(b)"] and got["stages"][1]["variables"] == ["a", "c"]
    assert explain("RETURN 1 AS x UNION RETURN 2 AS x")["stages"][0]["details"]["separators"] == ["UNION"]


@pytest.mark.parametrize("text", ["", "MATCH", "MATCH (n RETURN n", "RETURN", "MATCH (n) RETURN n LIMIT x", "CALL db.labels()", "RETURN 1 AS", "MATCH (a)-[*1.2]->(b) RETURN a", "RETURN 'open"])
def test_syntax_errors(text):
    with pytest.raises(QuerySyntaxError):
        arcweft.parse(text)


def test_cache(spark, tmp_path):
    path = tmp_path / "g.json"
    path.write_text(json.dumps(broken(nodes=DATA["nodes"][:1], edges=[])))
    cache = GraphCache(str(tmp_path / "cache"), keep=1)
    for _ in range(2):
        assert rows(cache.load(spark, str(path)), "MATCH (n:User) RETURN n.age AS a") == [(3,)]
    assert len(list((tmp_path / "cache").glob("*/note.json"))) == 1
    cache.load(spark, str(path), GraphConfig(label_property="name"))
    assert len(list((tmp_path / "cache").glob("*/note.json"))) == 1


def test_formats_and_command_line(spark, tmp_path):
    def convert(content, path, label_property, edge_type_property):
        first, second = content.split("edges:")
        nodes = [{"key": k.strip(), "attributes": {label_property: "N"}} for k in first.split(":")[1].split(",")]
        edges = [dict(zip(("source", "target"), e.strip().split("->"), strict=True)) for e in second.split(",")]
        return {"nodes": nodes, "edges": edges}

    register_format("mock", convert)
    with pytest.raises(GraphError):
        register_format("MOCK", convert)
    path = tmp_path / "g.mock"
    path.write_text("nodes: A,B edges: A->B")

    def run(*args):
        out = io.StringIO()
        code = cli.main([*args, "--no-cache"], spark, out)
        return code, out.getvalue()

    assert run("-g", str(path), "-e", "MATCH (a:N)-->(b) RETURN id(a) AS a, id(b) AS b") == (0, '{"a":"A","b":"B"}\n')
    code, text = run("-g", str(path), "-e", "MATCH (a)-[r]->(b) RETURN a, r, b")
    assert [n["key"] for n in json.loads(text)["nodes"]] == ["A", "B"] and json.loads(text)["edges"][0]["key"] == "edge_0"
    assert json.loads(run("-g", str(path), "--pass-through")[1])["edges"][0]["source"] == "A"
    assert json.loads(run("--explain", "-e", "RETURN 1 AS x")[1])["finalVariables"] == ["x"]
    assert "mock" in json.loads(run("--list-extensions")[1])["formats"]
    assert run("-g", str(path), "-e", "MATCH (n RETURN n")[0] == 1


def test_streamed_edges(spark, tmp_path):
    people = spark.createDataFrame([(1, "a"), (2, "b")], "k long, name string")
    folder = str(tmp_path / "in")
    spark.createDataFrame([(1, 2, "2024-01-01 00:01:00"), (2, 1, "2024-01-01 00:02:00"), (1, 1, "2024-01-01 00:09:00")], "s long, t long, at string").withColumn("at", F.col("at").cast("timestamp")).write.parquet(folder)
    stream = spark.readStream.schema("s long, t long, at timestamp").parquet(folder)
    base = PropertyGraph(spark, (NodeTable(people, "k", {"name": "name"}, label="P"),), ())
    g = with_streamed_edges(base, stream, "s", "t", "SAW", "P", "P")
    hits = g.cypher("MATCH (a:P)-[r:SAW]->(b:P) RETURN a.name AS a, b.name AS b, r.at AS at")
    counts = windowed_counts(hits, "at", ["a"])
    q = counts.writeStream.format("memory").queryName("seen").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    assert q.awaitTermination(120)
    assert sorted(tuple(r) for r in spark.sql("select a, matches from seen").collect()) == [("a", 1), ("a", 1), ("b", 1)]
    with pytest.raises(ValueError):
        with_streamed_edges(base, people, "k", "k", "X", "P", "P")


def test_cache_waits_for_a_lock_and_takes_a_stale_one(spark, tmp_path, monkeypatch):
    import os
    import threading

    from arcweft.sources import cache

    data = json.loads(json.dumps(DATA))
    data["nodes"][1]["attributes"]["label"] = "User"
    path = tmp_path / "g.json"
    path.write_text(json.dumps(data))
    kept = GraphCache(str(tmp_path / "kept"))
    lock = tmp_path / "kept" / f"{kept.key(str(path), GraphConfig())}.lock"
    lock.parent.mkdir()
    lock.write_text("")
    threading.Timer(1.0, lock.unlink).start()
    assert rows(kept.load(spark, str(path)), "MATCH (n) RETURN count(n) AS c") == [(2,)] and not lock.exists()
    path.write_text(json.dumps(data) + " ")
    lock.write_text("")
    os.utime(lock, (1, 1))
    monkeypatch.setattr(cache, "PAUSE", 0.01)
    assert rows(kept.load(spark, str(path)), "MATCH (n) RETURN count(n) AS c") == [(2,)]
