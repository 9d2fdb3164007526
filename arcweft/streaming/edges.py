"""Patterns over a stream of edges: each new edge is matched with static node tables.

A hop with both ends in static tables keeps no state: every micro-batch joins its own edges, so nothing grows
with the stream.  Windowed counts use a watermark on the event time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import EdgeTable, PropertyGraph


def with_streamed_edges(graph: PropertyGraph, edges: DataFrame, source: str, target: str, type: str, source_label: str, target_label: str, props: dict | None = None) -> PropertyGraph:
    """The graph whose relationships of one type are the rows of a stream."""
    if not edges.isStreaming:
        raise ValueError("edges must be a streaming DataFrame")
    columns = props if props is not None else {c: c for c in edges.columns if c not in (source, target)}
    table = EdgeTable(edges, source, target, columns, type=type, source_label=source_label, target_label=target_label)
    return PropertyGraph(graph.spark, graph.nodes, tuple(t for t in graph.edges if t.type != type) + (table,), graph.config)


def windowed_counts(matches: DataFrame, time: str, keys: list[str], window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Matches per key and window of event time; rows later than the watermark are left out."""
    return matches.withWatermark(time, late).groupBy(F.window(time, window), *keys).agg(F.count("*").alias("matches"))
