"""arcweft: property-graph analytics on Spark DataFrames.

    graph = load_graph(spark, "graph.json")
    graph.cypher("MATCH (a)-[:KNOWS]->(b) RETURN a.name, b.name").show()
"""

from .errors import GraphError, QueryError, QuerySyntaxError
from .explain import explain, explain_plan
from .functions.registry import REGISTRY, FunctionError, register_column_function, register_function
from .graph import EdgeTable, GraphConfig, NodeTable, PropertyGraph
from .parser import parse
from .sources.builder import GraphBuilder
from .sources.formats import load as load_graph
from .sources.formats import register_format
from .sources.graph_json import graph_from_dict, validate
from .sources.tables import table_graph


def execute_query(graph_or_data, query: str, spark=None, config: GraphConfig | None = None):
    """Rows of a query over a PropertyGraph or over graph JSON as a dict."""
    if isinstance(graph_or_data, dict):
        graph_or_data = graph_from_dict(spark, graph_or_data, config)
    return graph_or_data.cypher(query)


__all__ = [
    "REGISTRY", "EdgeTable", "FunctionError", "GraphBuilder", "GraphConfig", "GraphError", "NodeTable", "PropertyGraph", "QueryError", "QuerySyntaxError", "execute_query",
    "explain", "explain_plan", "graph_from_dict", "load_graph", "parse", "register_column_function", "register_format", "register_function", "table_graph", "validate",
]
