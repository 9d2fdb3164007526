"""Graph JSON: {options, attributes, nodes: [{key, attributes}], edges: [{key, source, target, undirected, attributes}]}."""

from __future__ import annotations

import json
import warnings
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import GraphError
from ..graph import GraphConfig, PropertyGraph

TYPES = ("directed", "undirected", "mixed")


def validate(data) -> list[str]:
    """Raise GraphError for what can't be loaded; return warnings for what can be ignored."""
    if not isinstance(data, dict) or not isinstance(data.get("nodes"), list) or not isinstance(data.get("edges"), list):
        raise GraphError("a graph needs arrays of nodes and edges")
    options = data.get("options") or {}
    kind = options.get("type", "mixed" if any(isinstance(e, dict) and e.get("undirected") for e in data["edges"]) else "directed")
    if kind not in TYPES:
        raise GraphError(f"options.type must be one of {', '.join(TYPES)}")
    notes, keys, edge_keys, pairs = [], set(), set(), set()
    for n in data["nodes"]:
        if not isinstance(n, dict) or not isinstance(n.get("key"), str) or not n["key"]:
            raise GraphError("a node's key must be a non-empty string")
        if not isinstance(n.get("attributes", {}), dict):
            raise GraphError(f"attributes of node {n['key']!r} must be an object")
        if n["key"] in keys:
            raise GraphError(f"duplicate node id {n['key']!r}")
        keys.add(n["key"])
    for e in data["edges"]:
        if not isinstance(e, dict):
            raise GraphError("an edge must be an object")
        s, t = e.get("source"), e.get("target")
        if not isinstance(s, str) or not s or not isinstance(t, str) or not t:
            raise GraphError("an edge's source and target must be non-empty strings")
        if not isinstance(e.get("attributes", {}), dict):
            raise GraphError(f"attributes of edge {s!r} to {t!r} must be an object")
        for end in (s, t):
            if end not in keys:
                raise GraphError(f"edge end {end!r} is no node")
        if s == t and not options.get("allowSelfLoops", True):
            raise GraphError(f"self loop at {s!r}")
        if e.get("undirected") and kind == "directed":
            notes.append(f"undirected edge {s!r} to {t!r} in a directed graph is taken as directed")
        if e.get("key") is not None:
            if e["key"] in edge_keys:
                notes.append(f"duplicate edge key {e['key']!r}: the second edge gets a key of its own")
            edge_keys.add(e["key"])
        if not options.get("multi", False):
            flat = kind == "undirected" or (kind == "mixed" and e.get("undirected"))
            pair = (frozenset((s, t)) if flat else (s, t), bool(flat))
            if pair in pairs:
                raise GraphError(f"second edge from {s!r} to {t!r} in a graph that is not multi")
            pairs.add(pair)
    return notes


def _spark_type(values: list) -> T.DataType:
    """The type that holds all values of an attribute; what fits no other type becomes text."""
    values = [v for v in values if v is not None]
    if not values:
        return T.StringType()
    if all(isinstance(v, bool) for v in values):
        return T.BooleanType()
    if all(isinstance(v, int) and not isinstance(v, bool) and abs(v) < 1 << 63 for v in values):
        return T.LongType()
    if all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in values):
        return T.DoubleType()
    if all(isinstance(v, list) for v in values):
        return T.ArrayType(_spark_type([x for v in values for x in v]))
    if all(isinstance(v, dict) for v in values):
        names = sorted({k for v in values for k in v})
        return T.StructType([T.StructField(n, _spark_type([v.get(n) for v in values])) for n in names])
    return T.StringType()


def _fit(value, kind: T.DataType):
    if value is None:
        return None
    if isinstance(kind, T.StringType):
        return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)
    if isinstance(kind, T.DoubleType):
        return float(value)
    if isinstance(kind, T.ArrayType):
        return [_fit(x, kind.elementType) for x in value]
    if isinstance(kind, T.StructType):
        return {f.name: _fit(value.get(f.name), f.dataType) for f in kind.fields}
    return value


def graph_from_dict(spark: SparkSession, data: dict, config: GraphConfig | None = None) -> PropertyGraph:
    """A graph from parsed JSON that fits in the driver; files go through ``read_graph``."""
    for note in validate(data):
        warnings.warn(note, stacklevel=3)
    config = config or GraphConfig()
    options = data.get("options") or {}
    config = replace(config, graph_type=options.get("type", "mixed" if any(e.get("undirected") for e in data["edges"]) else "directed"))
    label = config.label_property
    kinds: dict[str, T.DataType] = {}
    attrs = [n.get("attributes") or {} for n in data["nodes"]]
    for name in dict.fromkeys(k for a in attrs for k in a if k not in ("labels",)):
        kinds[name] = _spark_type([a.get(name) for a in attrs])
    if label in kinds and any(isinstance(a.get(label), list) for a in attrs):
        kinds[label] = T.ArrayType(T.StringType())
    kinds.pop("id", None)
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("labels", T.ArrayType(T.StringType())), *[T.StructField(k, t) for k, t in kinds.items()]])
    rows = []
    for n, a in zip(data["nodes"], attrs, strict=True):
        own = a.get(label)
        labels = [] if own is None else [str(x) for x in own] if isinstance(own, list) else [str(own)]
        values = {**a, label: labels if label in kinds and isinstance(kinds[label], T.ArrayType) and own is not None else own}
        rows.append((n["key"], labels, *[_fit(values.get(k), t) for k, t in kinds.items()]))
    nodes = spark.createDataFrame(rows, schema)
    etype = config.edge_type_property
    attrs = [e.get("attributes") or {} for e in data["edges"]]
    ekinds = {k: _spark_type([a.get(k) for a in attrs]) for k in dict.fromkeys(k for a in attrs for k in a) if k not in ("id", "source", "target", "undirected", "type", etype)}
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("id", "source", "target", "type")] + [T.StructField("undirected", T.BooleanType())] + [T.StructField(k, t) for k, t in ekinds.items()])
    rows, used = [], set()
    for i, (e, a) in enumerate(zip(data["edges"], attrs, strict=True)):
        key = e.get("key")
        if key is None or key in used:
            key = f"edge_{i}"
        used.add(key)
        kind = a.get(etype, e.get("type"))
        flat = config.graph_type == "undirected" or (config.graph_type == "mixed" and bool(e.get("undirected")))
        rows.append((key, e["source"], e["target"], None if kind is None else str(kind), flat, *[_fit(a.get(k), t) for k, t in ekinds.items()]))
    edges = spark.createDataFrame(rows, schema)
    return PropertyGraph(spark, (), (), config).with_frames(nodes, edges)


def read_graph(spark: SparkSession, path: str, config: GraphConfig | None = None, check: bool = True) -> PropertyGraph:
    """A graph from a JSON file that Spark reads: attributes get the types that Spark infers."""
    config = config or GraphConfig()
    raw = spark.read.option("multiLine", True).json(path)
    if "nodes" not in raw.columns or "edges" not in raw.columns:
        raise GraphError("a graph needs arrays of nodes and edges")
    options = raw.select("options.*").first().asDict() if "options" in raw.columns and isinstance(raw.schema["options"].dataType, T.StructType) else {}
    nodes = _exploded(raw, "nodes")
    edges = _exploded(raw, "edges")
    kind = options.get("type") or ("mixed" if "undirected" in edges.columns else "directed")
    config = replace(config, graph_type=kind)
    label, etype = config.label_property, config.edge_type_property
    names = dict(nodes.dtypes)
    own = F.lit(None).cast("array<string>") if label not in names else F.col(label).cast("array<string>") if names[label].startswith("array") else F.when(F.col(label).isNotNull(), F.array(F.col(label).cast("string")))
    nodes = nodes.select(F.col("__key").alias("id"), F.coalesce(own, F.array().cast("array<string>")).alias("labels"), *[F.col(f"`{c}`") for c in nodes.columns if c not in ("__key", "id", "labels")])
    have = edges.columns
    key = F.coalesce(F.col("__key"), F.concat(F.lit("edge_"), F.col("__n").cast("string"))) if "__key" in have else F.concat(F.lit("edge_"), F.col("__n").cast("string"))
    flat = F.lit(kind == "undirected") if kind != "mixed" or "undirected" not in have else F.coalesce(F.col("undirected"), F.lit(False))
    edges = edges.select(
        key.alias("id"), F.col("source"), F.col("target"), (F.col(f"`{etype}`").cast("string") if etype in have else F.lit(None).cast("string")).alias("type"), flat.alias("undirected"),
        *[F.col(f"`{c}`") for c in have if c not in ("__key", "__n", "id", "source", "target", "undirected", "type", etype)],
    )
    g = PropertyGraph(spark, (), (), config).with_frames(nodes, edges)
    if check:
        g.check()
    return g


def _exploded(raw: DataFrame, name: str) -> DataFrame:
    kind = raw.schema[name].dataType.elementType if isinstance(raw.schema[name].dataType, T.ArrayType) else None
    if not isinstance(kind, T.StructType):  # an empty array has no fields to infer
        return raw.sparkSession.createDataFrame([], "__key string" if name == "nodes" else "__n int, source string, target string")
    rows = raw.select(F.posexplode(name).alias("__n", "x"))
    top = [f.name for f in kind.fields if f.name not in ("key", "attributes")]
    attrs = kind["attributes"].dataType if "attributes" in kind.fieldNames() else None
    inner = [f.name for f in attrs.fields if f.name not in top] if isinstance(attrs, T.StructType) else []
    cols = [F.col(f"x.`{c}`").alias(c) for c in top] + [F.col(f"x.attributes.`{c}`").alias(c) for c in inner]
    key = [F.col("x.key").alias("__key")] if "key" in kind.fieldNames() else []
    return rows.select("__n", *key, *cols) if name == "edges" else rows.select(*key, *cols)


def result_graph(df: DataFrame) -> dict | None:
    """Unique nodes and relationships in a result, as graph JSON; None if it holds none."""
    nodes, edges = {}, {}

    def take(v):
        if isinstance(v, list):
            for x in v:
                take(x)
        elif isinstance(v, dict):
            if {"id", "source", "target"} <= v.keys():
                edges.setdefault(v["id"], v)
            elif {"id", "labels"} <= v.keys():
                nodes.setdefault(v["id"], v)
            else:
                for x in v.values():
                    take(x)

    for line in df.toJSON().toLocalIterator():
        take(json.loads(line))
    if not nodes and not edges:
        return None
    return {
        "nodes": [{"key": k, "attributes": {a: x for a, x in v.items() if a not in ("id", "labels")}} for k, v in nodes.items()],
        "edges": [{"key": k, "source": v["source"], "target": v["target"], "attributes": {a: x for a, x in v.items() if a not in ("id", "source", "target")}} for k, v in edges.items()],
    }
