"""The graph: node, edge and annotation tables behind one small object."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import schema
from .plans.fixpoint import write_out


def _full(df: DataFrame, spec: str) -> DataFrame:
    """``df`` with the columns of ``spec``, null where it lacks one."""
    kinds = dict(x.split() for x in spec.split(", "))
    return df.select(*(F.col(c).cast(k).alias(c) if c in df.columns else F.lit(None).cast(k).alias(c) for c, k in kinds.items()))


@dataclass(frozen=True)
class Graph:
    """A directed multigraph. ``edges_raw`` keeps every emitted edge; ``edges`` has one row for each
    (src, dst, kind), with the last attributes given."""

    nodes: DataFrame
    edges_raw: DataFrame
    node_annotations: DataFrame
    edge_annotations: DataFrame

    @classmethod
    def of(cls, nodes: DataFrame, edges: DataFrame, node_annotations: DataFrame | None = None, edge_annotations: DataFrame | None = None) -> Graph:
        empty = lambda spec: nodes.sparkSession.createDataFrame([], spec)
        return cls(
            _full(nodes, schema.NODES),
            _full(edges, schema.EDGES),
            empty(schema.NODE_ANNOTATIONS) if node_annotations is None else _full(node_annotations, schema.NODE_ANNOTATIONS),
            empty(schema.EDGE_ANNOTATIONS) if edge_annotations is None else _full(edge_annotations, schema.EDGE_ANNOTATIONS),
        )

    @property
    def spark(self) -> SparkSession:
        return self.nodes.sparkSession

    def written(self) -> Graph:
        """The same graph with its nodes and edges written to tables of the scratch folder, so that what
        they come from is worked out once."""
        return replace(self, nodes=write_out(self.nodes, "nodes")[0], edges_raw=write_out(self.edges_raw, "edges")[0])

    @property
    def edges(self) -> DataFrame:
        last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.coalesce("seq", F.lit(-1)))).alias(c)
        return self.edges_raw.groupBy("src", "dst", "kind").agg(last("field_name"), last("interprocedural"), last("attrs"), F.min("seq").alias("seq"))

    @property
    def typed_nodes(self) -> DataFrame:
        return self.nodes.withColumn("a", F.from_json("attrs", schema.ATTRS)).select("*", "a.*").drop("a")

    # -- access ---------------------------------------------------------------------------------

    def node(self, node_id: str) -> DataFrame:
        return self.nodes.where(F.col("id") == node_id)

    def nodes_of(self, kind: str | None = None, file: str | None = None) -> DataFrame:
        out = self.nodes if kind is None else self.nodes.where(F.col("kind") == kind)
        return out if file is None else out.where(F.col("file") == file)

    def edges_of(self, kind: str | None = None) -> DataFrame:
        return self.edges if kind is None else self.edges.where(F.col("kind") == kind)

    def _along(self, ids: DataFrame, near: str, far: str, kind: str | None) -> DataFrame:
        e = self.edges_raw if kind is None else self.edges_raw.where(F.col("kind") == kind)
        hop = e.select(F.col(near).alias("_from"), F.col(far).alias("_to"))
        hop = hop.distinct() if kind is None else hop
        return ids.select(F.col("id").alias("of")).join(hop, F.col("of") == F.col("_from")).join(self.nodes, F.col("_to") == F.col("id")).drop("_from", "_to")

    def successors(self, ids: DataFrame, kind: str | None = None) -> DataFrame:
        """Neighbours of each id in ``ids``; of one kind as often as emitted, else distinct. Ids without a node are left out."""
        return self._along(ids, "src", "dst", kind)

    def predecessors(self, ids: DataFrame, kind: str | None = None) -> DataFrame:
        return self._along(ids, "dst", "src", kind)

    def scope_of(self, ids: DataFrame) -> DataFrame:
        child = self.nodes.join(ids.select("id"), "id", "left_semi").select(F.col("id").alias("of"), F.col("scope").alias("_scope"))
        return child.join(self.nodes, F.col("_scope") == F.col("id")).drop("_scope")

    def children_of(self, ids: DataFrame) -> DataFrame:
        return self.nodes.join(ids.select(F.col("id").alias("scope")), "scope", "left_semi").orderBy("seq", "id")

    def files(self) -> DataFrame:
        return self.nodes.where("file is not null").select("file").distinct().orderBy("file")

    def counts(self) -> DataFrame:
        """One row: ``nodes``, ``edges``, ``files``."""
        n = self.nodes.agg(F.count("*").alias("nodes"), F.count_distinct("file").alias("files"))
        e = self.edges_raw.agg(F.count_distinct("src", "dst", "kind").alias("edges"))
        return n.withColumn("_k", F.lit(0)).join(e.withColumn("_k", F.lit(0)), "_k").select("nodes", "edges", "files")

    def has_node(self, node_id: str) -> bool:
        return not self.node(node_id).limit(1).isEmpty()

    def has_edge(self, src: str, dst: str, kind: str | None = None) -> bool:
        return not self.edges_of(kind).where((F.col("src") == src) & (F.col("dst") == dst)).limit(1).isEmpty()

    # -- change ---------------------------------------------------------------------------------

    def add_nodes(self, nodes: DataFrame) -> Graph:
        """Rows of ``nodes`` replace those of the same id."""
        new = _full(nodes, schema.NODES)
        return replace(self, nodes=self.nodes.join(new.select("id"), "id", "left_anti").select(*schema.columns(schema.NODES)).unionByName(new))

    def add_edges(self, edges: DataFrame) -> Graph:
        return replace(self, edges_raw=self.edges_raw.unionByName(_full(edges, schema.EDGES)))

    def remove_nodes(self, ids: DataFrame) -> Graph:
        """Without the nodes, their edges and all annotations of those; children stay, with a dangling scope."""
        gone = ids.select(F.col("id").alias("_gone")).distinct()
        drop = lambda df, *cols: _without(df, gone, cols)
        return Graph(drop(self.nodes, "id"), drop(self.edges_raw, "src", "dst"), drop(self.node_annotations, "id"), drop(self.edge_annotations, "src", "dst"))

    def remove_edges(self, pairs: DataFrame, kind: str | None = None) -> Graph:
        """Without the edges between ``pairs`` (src, dst), of one kind or all, and those pairs' annotations."""
        p = pairs.select("src", "dst").distinct()
        mine = self.edges_raw.join(p, ["src", "dst"], "left_anti")
        if kind is not None:
            mine = mine.unionByName(self.edges_raw.where(F.col("kind") != kind).join(p, ["src", "dst"], "left_semi"))
        return replace(self, edges_raw=mine.select(*schema.columns(schema.EDGES)), edge_annotations=self.edge_annotations.join(p, ["src", "dst"], "left_anti"))

    # -- annotations ----------------------------------------------------------------------------

    def annotate_nodes(self, rows: DataFrame) -> Graph:
        """``rows`` (id, key, value[, seq]); the row of the greatest seq wins, later calls over earlier ones."""
        return replace(self, node_annotations=_upsert(self.node_annotations, _full(rows, schema.NODE_ANNOTATIONS), ["id", "key"]))

    def annotate_edges(self, rows: DataFrame) -> Graph:
        return replace(self, edge_annotations=_upsert(self.edge_annotations, _full(rows, schema.EDGE_ANNOTATIONS), ["src", "dst", "key"]))

    def annotations_for(self, ids: DataFrame) -> DataFrame:
        return self.node_annotations.join(ids.select("id"), "id", "left_semi").select("id", "key", "value")

    def with_annotation_map(self) -> DataFrame:
        """Nodes with ``annotations``, a map from key to JSON value."""
        m = self.node_annotations.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("annotations"))
        return self.nodes.join(m, "id", "left")


def _without(df: DataFrame, gone: DataFrame, cols: tuple[str, ...]) -> DataFrame:
    for c in cols:
        df = df.join(gone, F.col(c) == F.col("_gone"), "left_anti")
    return df


def _upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_new"), F.desc_nulls_last("seq"), F.desc("value")))
    return both.withColumn("_r", rank).where("_r = 1").select(*old.columns)


def attr(name: str) -> Column:
    """A node attribute as a string."""
    return F.get_json_object("attrs", f"$.{name}")
