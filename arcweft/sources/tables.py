"""The property graph over the relational tables: one node table per label, one edge table per foreign key."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..graph import EdgeTable, GraphConfig, NodeTable, PropertyGraph

# fixed values: label, table, prefix of its columns, key
NODES = (
    ("Region", "region", "r_", "r_regionkey"),
    ("Nation", "nation", "n_", "n_nationkey"),
    ("Customer", "customer", "c_", "c_custkey"),
    ("Supplier", "supplier", "s_", "s_suppkey"),
    ("Part", "part", "p_", "p_partkey"),
    ("Order", "orders", "o_", "o_orderkey"),
    ("Event", "events", "", "event_id"),
)
# type, table, source column and label, target column and label, whether the row's columns are its properties
EDGES = (
    ("IN_REGION", "nation", "n_nationkey", "Nation", "n_regionkey", "Region", False),
    ("IN_NATION", "customer", "c_custkey", "Customer", "c_nationkey", "Nation", False),
    ("IN_NATION", "supplier", "s_suppkey", "Supplier", "s_nationkey", "Nation", False),
    ("PLACED", "orders", "o_custkey", "Customer", "o_orderkey", "Order", False),
    ("CONTAINS", "lineitem", "l_orderkey", "Order", "l_partkey", "Part", True),
    ("SUPPLIED_BY", "lineitem", "l_orderkey", "Order", "l_suppkey", "Supplier", True),
    ("DID", "events", "user_id", "Customer", "event_id", "Event", False),
)


def table_graph(spark: SparkSession, sf_dir: str, config: GraphConfig | None = None, labels: tuple | None = None) -> PropertyGraph:
    """The graph of a directory of Parquet tables; ``labels`` keeps only those node tables and the edges between them."""

    def read(name):
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    frames = {name: read(name) for name in dict.fromkeys(t for _, t, _, _ in NODES) if labels is None or name in {t for lab, t, _, _ in NODES if lab in labels}}
    nodes = tuple(NodeTable(frames[t], key, {c.removeprefix(prefix): c for c in frames[t].columns}, label=label) for label, t, prefix, key in NODES if labels is None or label in labels)
    edges = []
    for kind, t, source, a, target, b, props in EDGES:
        if labels is not None and not (a in labels and b in labels):
            continue
        df = frames.get(t)
        df = read(t) if df is None else df
        own = {c.removeprefix("l_"): c for c in df.columns if c not in (source, target)} if props else {}
        edges.append(EdgeTable(df, source, target, own, type=kind, source_label=a, target_label=b))
    return PropertyGraph(spark, nodes, tuple(edges), config or GraphConfig())
