"""Small graphs for the tests."""

from arcweft import PropertyGraph


def make(spark, nodes, edges, **options):
    data = {
        "options": {"multi": True, **options},
        "nodes": [{"key": k, "attributes": a} for k, a in nodes.items()],
        "edges": [{"key": f"e{i}", "source": s, "target": t, "attributes": a, **({"undirected": True} if a.pop("undirected", False) else {})} for i, (s, t, a) in enumerate((s, t, dict(a)) for s, t, a in edges)],
    }
    return PropertyGraph.from_json(spark, data)


def users(spark):
    ages = {"alice": 30, "bob": 25, "charlie": 35, "dave": 28}
    nodes = {k: {"label": "User", "name": k, "age": a} for k, a in ages.items()}
    return make(spark, nodes, [("alice", "bob", {"type": "FRIEND"}), ("bob", "charlie", {"type": "FRIEND"}), ("alice", "dave", {"type": "KNOWS"})])


def chain(spark):
    nodes = {c: {"label": "Node", "name": c} for c in "ABCDEFGHIJKL"}
    return make(spark, nodes, [(a, b, {"type": "NEXT"}) for a, b in zip("ABCDEFGHIJK", "BCDEFGHIJKL", strict=True)])


def diamond(spark):
    nodes = {c: {"label": "P", "name": c} for c in "abcd"}
    return make(spark, nodes, [("a", "d", {"type": "L"}), ("a", "b", {"type": "L"}), ("b", "d", {"type": "L"}), ("a", "c", {"type": "L"}), ("c", "d", {"type": "L"})])


def rows(graph, query):
    return [tuple(r) for r in graph.cypher(query).collect()]
