"""Command line: run a query over a graph file.

    python -m arcweft.cli -g graph.json -e "MATCH (n) RETURN n"
"""

from __future__ import annotations

import argparse
import json
import os
import sys
import tempfile

from pyspark.sql import SparkSession

from .errors import GraphError
from .explain import explain
from .functions.registry import REGISTRY
from .graph import GraphConfig
from .sources import formats
from .sources.cache import GraphCache
from .sources.graph_json import graph_from_dict, result_graph


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="arcweft", description="Query a property graph with Cypher on Spark.")
    p.add_argument("-g", "--graph", help="graph file, or - for standard input")
    p.add_argument("-e", "--execute", metavar="QUERY", help="query text")
    p.add_argument("-nl", "--node-label", default="label", help="attribute that holds a node's label")
    p.add_argument("-et", "--edge-type", default="type", help="attribute that holds an edge's type")
    p.add_argument("--format", choices=("rows", "graph"), default="graph", help="result as graph JSON where it holds nodes or edges, or as rows")
    p.add_argument("--explain", action="store_true", help="show the stages of the query instead of running it")
    p.add_argument("--ext", action="append", default=[], metavar="MODULE", help="Python module that registers formats")
    p.add_argument("--ext-fn", action="append", default=[], metavar="MODULE", help="Python module that registers functions")
    p.add_argument("--list-extensions", action="store_true")
    p.add_argument("--no-cache", action="store_true")
    p.add_argument("--cache-dir", help="folder for parsed graphs, on a cluster one that all executors share; without it only a local master caches")
    p.add_argument("--pass-through", action="store_true", help="check the graph and write it out again")
    return p


def _load(spark: SparkSession, a, config: GraphConfig):
    if a.graph == "-":
        return graph_from_dict(spark, json.load(sys.stdin), config)
    folder = a.cache_dir
    if not folder and spark.sparkContext.master.startswith("local["):
        folder = os.path.join(tempfile.gettempdir(), "arcweft-cache")
    return formats.load(spark, a.graph, config) if a.no_cache or not folder else GraphCache(folder).load(spark, a.graph, config)


def _write_graph(graph, out) -> None:
    """The graph as JSON, row by row: the driver holds one partition at a time."""

    def lines(df, shape):
        for i, line in enumerate(df.toJSON().toLocalIterator()):
            out.write((", " if i else "") + json.dumps(shape(json.loads(line)), ensure_ascii=False))

    out.write(f'{{"options": {json.dumps({"type": graph.config.graph_type, "multi": True})}, "nodes": [')
    lines(graph.node_frame(), lambda n: {"key": n.pop("id"), "attributes": {k: v for k, v in n.items() if k != "labels"}})
    out.write('], "edges": [')
    lines(graph.edge_frame(), lambda e: {"key": e.pop("id"), "source": e.pop("source"), "target": e.pop("target"), "undirected": e.pop("undirected", False), "attributes": e})
    out.write("]}\n")


def main(argv=None, spark: SparkSession | None = None, out=None) -> int:
    out = out or sys.stdout
    parser = arguments()
    a = parser.parse_args(argv)
    for module in (*a.ext, *a.ext_fn):
        __import__(module)
    if a.list_extensions:
        print(json.dumps({"formats": formats.formats(), "functions": REGISTRY.names(), "packages": formats.discover()}), file=out)
        return 0
    if a.explain:
        if not a.execute:
            parser.error("--explain needs a query")
        print(json.dumps(explain(a.execute), indent=2), file=out)
        return 0
    if not a.graph or not (a.execute or a.pass_through):
        parser.error("a graph and a query are needed")
    spark = spark or SparkSession.builder.appName("arcweft").getOrCreate()
    config = GraphConfig(label_property=a.node_label, edge_type_property=a.edge_type)
    try:
        graph = _load(spark, a, config)
        if a.pass_through:
            graph.check()
            _write_graph(graph, out)
            return 0
        df = graph.cypher(a.execute)
        found = result_graph(df) if a.format == "graph" else None
        if found is not None:
            print(json.dumps(found, ensure_ascii=False), file=out)
        else:
            for line in df.toJSON().toLocalIterator():
                print(line, file=out)
    except (GraphError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
