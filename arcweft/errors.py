"""Errors of the engine."""


class GraphError(ValueError):
    """A graph that breaks its own rules."""


class QuerySyntaxError(ValueError):
    """Query text that can't be read."""


class QueryError(ValueError):
    """A query that can be read but not planned."""
