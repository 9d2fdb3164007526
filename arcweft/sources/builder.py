"""A graph made step by step in the driver, for small graphs and tests."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..errors import GraphError
from ..graph import GraphConfig, PropertyGraph
from .graph_json import graph_from_dict


class GraphBuilder:
    """Collects nodes and edges; ``build`` checks them and makes a PropertyGraph."""

    def __init__(self, graph_type: str = "directed", multi: bool = True, allow_self_loops: bool = True):
        self.options = {"type": graph_type, "multi": multi, "allowSelfLoops": allow_self_loops}
        self.nodes: dict[str, dict] = {}
        self.edges: dict[str, dict] = {}

    def add_node(self, key: str, **attributes) -> GraphBuilder:
        if key in self.nodes:
            raise GraphError(f"duplicate node id {key!r}")
        self.nodes[key] = attributes
        return self

    def add_edge(self, source: str, target: str, key: str | None = None, undirected: bool = False, **attributes) -> GraphBuilder:
        key = key or f"edge_{len(self.edges)}"
        if key in self.edges:
            raise GraphError(f"duplicate edge key {key!r}")
        for end in (source, target):
            if end not in self.nodes:
                raise GraphError(f"edge end {end!r} is no node")
        self.edges[key] = {"source": source, "target": target, "undirected": undirected, "attributes": attributes}
        return self

    def set_node(self, key: str, **attributes) -> GraphBuilder:
        self.nodes[key].update(attributes)
        return self

    def drop_node(self, key: str) -> GraphBuilder:
        del self.nodes[key]
        self.edges = {k: e for k, e in self.edges.items() if key not in (e["source"], e["target"])}
        return self

    def drop_edge(self, key: str) -> GraphBuilder:
        del self.edges[key]
        return self

    def to_dict(self) -> dict:
        return {
            "options": self.options,
            "nodes": [{"key": k, "attributes": a} for k, a in self.nodes.items()],
            "edges": [{"key": k, **e} for k, e in self.edges.items()],
        }

    def build(self, spark: SparkSession, config: GraphConfig | None = None) -> PropertyGraph:
        return graph_from_dict(spark, self.to_dict(), config)
