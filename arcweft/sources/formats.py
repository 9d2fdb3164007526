"""Graph formats supplied by the user: a converter from file text to graph JSON, by file extension."""

from __future__ import annotations

from collections.abc import Callable
from importlib.metadata import entry_points

from pyspark.sql import SparkSession

from ..errors import GraphError
from ..graph import GraphConfig, PropertyGraph
from .graph_json import graph_from_dict, read_graph

_CONVERTERS: dict[str, Callable] = {}
#: Entry-point group in which installed packages offer a function that takes this module and registers things.
GROUP = "arcweft.extensions"


def register_format(extension: str, convert: Callable) -> None:
    """``convert(content, path, label_property, edge_type_property)`` gives graph JSON as a dict."""
    key = extension.lower().lstrip(".")
    if not key or key in _CONVERTERS or key == "json":
        raise GraphError(f"format {extension!r} is taken or empty")
    _CONVERTERS[key] = convert


def formats() -> list[str]:
    return sorted(_CONVERTERS)


def discover() -> list[str]:
    """Load the extensions of installed packages; returns their names."""
    found = []
    for e in entry_points(group=GROUP):
        e.load()()
        found.append(e.name)
    return found


def load(spark: SparkSession, path: str, config: GraphConfig | None = None) -> PropertyGraph:
    """A graph file by its extension: JSON through Spark, others through their converter."""
    config = config or GraphConfig()
    extension = path.rsplit(".", 1)[-1].lower()
    convert = _CONVERTERS.get(extension)
    if convert is None:
        return read_graph(spark, path, config)
    content = "\n".join(r["value"] for r in spark.read.option("wholetext", True).text(path).collect())
    return graph_from_dict(spark, convert(content=content, path=path, label_property=config.label_property, edge_type_property=config.edge_type_property), config)
