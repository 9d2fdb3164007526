"""Property graphs over DataFrames.

A graph is a catalog of node tables and edge tables.  A typed table holds one label or one relationship type
and keeps its own key column, so joins run on the stored keys and unused tables are never read.  A generic
table (from JSON, or after writes) holds rows of any label with a string id and an array of labels.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce as fold

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import GraphError


@dataclass(frozen=True)
class GraphConfig:
    """Names of the label and type properties, and guards for variable-length paths.

    ``max_paths`` is off by default.  If set, a variable-length hop that yields more paths raises an error, or with
    ``on_excess="stop"`` keeps that many, shorter ones first, with a warning.  A hop without an upper bound follows
    paths of up to ``max_var_length_depth`` steps, with a warning; a larger depth, or a bound in the pattern, gives more.
    """

    label_property: str = "label"
    edge_type_property: str = "type"
    max_var_length_depth: int = 10
    max_paths: int | None = None
    on_excess: str = "error"
    graph_type: str = "directed"


@dataclass(frozen=True)
class NodeTable:
    """Nodes: ``props`` maps property names to columns.  Typed tables have ``label`` and a key of any type."""

    df: DataFrame
    key: str
    props: dict
    label: str | None = None
    labels_column: str | None = None

    @property
    def space(self) -> str | None:
        return self.label


@dataclass(frozen=True)
class EdgeTable:
    """Edges: typed tables have ``type`` and name the labels whose keys the end columns hold."""

    df: DataFrame
    source: str
    target: str
    props: dict
    type: str | None = None
    type_column: str | None = None
    source_label: str | None = None
    target_label: str | None = None
    id_column: str | None = None
    undirected_column: str | None = None
    undirected: bool = False


def space_id(space: str | None, key: Column) -> Column:
    """The string id of a node: its key, in typed tables behind the label."""
    return key if space is None else F.concat(F.lit(f"{space}:"), key.cast("string"))


@dataclass(frozen=True)
class PropertyGraph:
    """A graph; writes give a new one."""

    spark: SparkSession
    nodes: tuple
    edges: tuple
    config: GraphConfig = field(default_factory=GraphConfig)

    # ---- making graphs

    @staticmethod
    def from_frames(nodes: DataFrame, edges: DataFrame, config: GraphConfig | None = None) -> PropertyGraph:
        """Generic tables: nodes(id, label or labels, …) and edges(id?, source, target, type?, undirected?, …)."""
        config = config or GraphConfig()
        names = nodes.columns
        label = config.label_property
        if "labels" not in names:
            kind = dict((f.name, f.dataType) for f in nodes.schema.fields).get(label)
            labels = F.lit(None).cast("array<string>") if kind is None else F.col(label) if isinstance(kind, T.ArrayType) else F.when(F.col(label).isNotNull(), F.array(F.col(label).cast("string")))
            nodes = nodes.withColumn("labels", F.coalesce(labels, F.array().cast("array<string>")))
        nodes = nodes.withColumn("id", F.col("id").cast("string"))
        node_props = {c: c for c in nodes.columns if c not in ("id", "labels")}
        if "id" not in edges.columns:
            edges = edges.withColumn("id", F.uuid()) if not edges.columns else edges.withColumn("id", F.concat_ws("-", "source", "target", F.hex(F.xxhash64(*edges.columns)), F.monotonically_increasing_id().cast("string")))
        if config.edge_type_property not in edges.columns:
            edges = edges.withColumn(config.edge_type_property, F.lit(None).cast("string"))
        edges = edges.withColumn("source", F.col("source").cast("string")).withColumn("target", F.col("target").cast("string"))
        reserved = ("id", "source", "target", "undirected")
        edge = EdgeTable(
            edges, "source", "target", {c: c for c in edges.columns if c not in reserved}, type_column=config.edge_type_property, id_column="id",
            undirected_column="undirected" if "undirected" in edges.columns else None, undirected=config.graph_type == "undirected",
        )
        return PropertyGraph(nodes.sparkSession, (NodeTable(nodes, "id", node_props, labels_column="labels"),), (edge,), config)

    @staticmethod
    def from_json(spark: SparkSession, data: dict, config: GraphConfig | None = None) -> PropertyGraph:
        from .sources.graph_json import graph_from_dict

        return graph_from_dict(spark, data, config)

    # ---- queries

    def cypher(self, text: str) -> DataFrame:
        """Rows of a query.  Its writes are lost; use ``execute`` to keep them."""
        return self.execute(text)[0]

    def execute(self, text: str) -> tuple[DataFrame, PropertyGraph]:
        """Rows of a query, and the graph after its writes."""
        from .plans.planner import run

        return run(self, text)

    # ---- generic views, for patterns without a label, paths and writes

    def node_frame(self) -> DataFrame:
        """All nodes as (id, labels, properties…)."""
        return _union([self._generic_nodes(t) for t in self.nodes]) if self.nodes else self.spark.createDataFrame([], "id string, labels array<string>")

    def _generic_nodes(self, t: NodeTable) -> DataFrame:
        labels = F.array(F.lit(t.label)) if t.label else F.col(t.labels_column)
        return t.df.select(space_id(t.space, F.col(t.key)).alias("id"), labels.alias("labels"), *[F.col(c).alias(p) for p, c in t.props.items()])

    def edge_frame(self) -> DataFrame:
        """All edges as (id, source, target, type, undirected, properties…)."""
        return _union([self._generic_edges(t) for t in self.edges]) if self.edges else self.spark.createDataFrame([], "id string, source string, target string, type string, undirected boolean")

    def _generic_edges(self, t: EdgeTable) -> DataFrame:
        props = {p: c for p, c in t.props.items() if p != self.config.edge_type_property}
        return t.df.select(
            edge_id(t).alias("id"), space_id(t.source_label, F.col(t.source)).alias("source"), space_id(t.target_label, F.col(t.target)).alias("target"),
            (F.lit(t.type) if t.type else F.col(t.type_column)).alias("type"), undirected(t).alias("undirected"), *[F.col(c).alias(p) for p, c in props.items()],
        )

    def generic(self) -> PropertyGraph:
        """The same graph with one generic node table and one generic edge table."""
        if len(self.nodes) == 1 and len(self.edges) == 1 and self.nodes[0].labels_column and self.edges[0].type_column == "type":
            return self
        nodes, edges = self.node_frame(), self.edge_frame()
        return self.with_frames(nodes, edges)

    def with_frames(self, nodes: DataFrame, edges: DataFrame) -> PropertyGraph:
        if "undirected" not in edges.columns:
            edges = edges.withColumn("undirected", F.lit(False))
        return replace(
            self,
            nodes=(NodeTable(nodes, "id", {c: c for c in nodes.columns if c not in ("id", "labels")}, labels_column="labels"),),
            edges=(EdgeTable(edges, "source", "target", {c: c for c in edges.columns if c not in ("id", "source", "target", "undirected")}, type_column="type", id_column="id", undirected_column="undirected"),),
        )

    def indexed(self, by: dict | None = None) -> PropertyGraph:
        """The same graph kept in memory for repeated queries: edges are dealt by their source, then persisted.

        Joins on the source then find their rows in place; typed tables keep their columns and pruning.  ``by`` names a
        property for a label (None: of a generic table): those nodes are kept in its order, so that a comparison with
        it skips the batches whose least and largest value rule it out.
        """
        from pyspark import StorageLevel

        def kept(df):
            return df.persist(StorageLevel.MEMORY_AND_DISK)

        def ordered(t):
            name = (by or {}).get(t.label)
            if name is None:
                return t.df
            if name not in t.props:
                raise GraphError(f"{t.label or 'nodes'} have no property {name!r}")
            return t.df.repartitionByRange(F.col(t.props[name])).sortWithinPartitions(t.props[name])

        nodes = tuple(replace(t, df=kept(ordered(t))) for t in self.nodes)
        return replace(self, nodes=nodes, edges=tuple(replace(t, df=kept(t.df.repartition(F.col(t.source)))) for t in self.edges))

    def release(self) -> None:
        """Give up what ``indexed`` keeps in memory."""
        for t in (*self.nodes, *self.edges):
            t.df.unpersist()

    def write_tables(self, folder: str) -> None:
        """The graph as Parquet: nodes split by label list, edges by type, for pruning at the next load."""
        nodes, edges = self.node_frame(), self.edge_frame()
        nodes.withColumn("__labels", F.array_join("labels", "|")).write.partitionBy("__labels").parquet(f"{folder}/nodes")
        edges.withColumn("__type", F.col("type")).write.partitionBy("__type").parquet(f"{folder}/edges")

    @staticmethod
    def read_tables(spark: SparkSession, folder: str, config: GraphConfig | None = None) -> PropertyGraph:
        """What ``write_tables`` wrote."""
        g = PropertyGraph(spark, (), (), config or GraphConfig())
        return g.with_frames(spark.read.parquet(f"{folder}/nodes").drop("__labels"), spark.read.parquet(f"{folder}/edges").drop("__type"))

    def check(self) -> None:
        """Raise GraphError for repeated node ids and dangling edge ends (two shuffles over the graph)."""
        nodes, edges = self.node_frame(), self.edge_frame()
        twice = nodes.groupBy("id").count().where("count > 1").limit(1).collect()
        if twice:
            raise GraphError(f"duplicate node id {twice[0]['id']!r}")
        ends = edges.select(F.explode(F.array("source", "target")).alias("id")).distinct()
        lost = ends.join(nodes.select("id"), "id", "left_anti").limit(1).collect()
        if lost:
            raise GraphError(f"edge end {lost[0]['id']!r} is no node")


def edge_id(t: EdgeTable) -> Column:
    """Edge id: the stored one, or for typed tables the type with a hash of the row."""
    if t.id_column:
        return F.col(t.id_column).cast("string")
    return F.concat(F.lit(f"{t.type}:"), F.lower(F.hex(F.xxhash64(*t.df.columns))))


def undirected(t: EdgeTable) -> Column:
    if t.undirected:
        return F.lit(True)
    return F.coalesce(F.col(t.undirected_column).cast("boolean"), F.lit(False)) if t.undirected_column else F.lit(False)


def _union(frames: list[DataFrame]) -> DataFrame:
    """All rows, columns aligned by name; a property of two types becomes text."""
    kinds: dict[str, set] = {}
    for f in frames:
        for c in f.schema.fields:
            kinds.setdefault(c.name, set()).add(c.dataType.simpleString())
    mixed = {}
    for name, k in kinds.items():
        if len(k) > 1:
            mixed[name] = "double" if k <= {"int", "bigint", "double", "float"} and k & {"double", "float"} else "bigint" if k <= {"int", "bigint"} else "string"
    cast = [f.select(*[F.col(f"`{c}`").cast(mixed[c]).alias(c) if c in mixed else F.col(f"`{c}`") for c in f.columns]) for f in frames]
    return fold(lambda a, b: a.unionByName(b, allowMissingColumns=True), cast)
