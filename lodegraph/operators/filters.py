"""Node and edge filters, lookups by place, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import extension
from ..graph import Graph
from ..plans.fixpoint import fixpoint

PLACE_ORDER = {"function": 0, "call": 1, "variable": 2}


def page(df: DataFrame, order: list[str], offset: int = 0, limit: int = 0) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` in the given order; a limit of 0 is none."""
    if offset or limit:
        df = df.orderBy(*order)
        df = df.offset(offset) if offset else df
        df = df.limit(limit) if limit else df
    return df


def scope_ancestors(nodes: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """Rows ``(id, ancestor)`` of the scope closure of ``of`` (all nodes by default)."""
    parents = nodes.where("scope is not null").select(F.col("id").alias("child"), F.col("scope").alias("parent"))
    start = parents if of is None else parents.join(of.select(F.col("id").alias("child")), "child", "left_semi")
    seed = start.select(F.col("child").alias("id"), F.col("parent").alias("ancestor"))
    step = lambda d: d.join(parents, d.ancestor == parents.child).select("id", F.col("parent").alias("ancestor"))
    return fixpoint(seed, step)


def in_scope_of(g: Graph, nodes: DataFrame, name: str) -> DataFrame:
    """Nodes with an ancestor scope of that exact name: grown downwards from the scopes of that name,
    so the closure is only as large as their subtrees."""
    child = g.nodes.where("scope is not null").select("id", "scope")
    seed = g.nodes.where(F.col("name") == name).select("id")
    inside = fixpoint(seed.join(child.withColumnRenamed("id", "c"), seed.id == F.col("scope")).select(F.col("c").alias("id")), lambda d: child.join(d.select(F.col("id").alias("scope")), "scope", "left_semi").select("id"))
    return nodes.join(inside, "id", "left_semi")


def query_nodes(g: Graph, kinds: list[str] | None = None, name: str | None = None, file: str | None = None, scope: str | None = None, annotation: str | None = None, value: str | None = None, offset: int = 0, limit: int = 0) -> DataFrame:
    """Nodes of any of the kinds whose name a regular expression finds, whose file holds a string,
    inside a scope of a name, with an annotation (of a value, compared as text)."""
    out = g.nodes
    if kinds:
        out = out.where(F.col("kind").isin(*(k.lower() for k in kinds)))
    if name:
        out = out.where(F.col("name").rlike(name))
    if file:
        out = out.where(F.contains("file", F.lit(file)))
    if scope:
        out = in_scope_of(g, out, scope)
    if annotation:
        out = out.join(annotated(g, annotation, value), "id", "left_semi")
    return page(out, ["seq", "id"], offset, limit)


def annotated(g: Graph, key: str, value: str | None = None) -> DataFrame:
    """Ids of nodes that carry an annotation; its value is compared as text without JSON quotes."""
    a = g.node_annotations.where(F.col("key") == key)
    if value is not None:
        a = a.where(plain_value(F.col("value")) == value)
    return a.select("id").distinct()


def plain_value(v: Column) -> Column:
    """A JSON scalar as text; true and false as Python writes them."""
    text = F.get_json_object(F.concat(F.lit('{"v":'), v, F.lit("}")), "$.v")
    return F.when(v == "true", "True").when(v == "false", "False").otherwise(text)


def query_edges(g: Graph, kinds: list[str] | None = None, source: str | None = None, target: str | None = None, offset: int = 0, limit: int = 0) -> DataFrame:
    """Edges with both ends present, by kinds and regular expressions on the ends' names."""
    e = g.edges.where(F.col("kind").isin(*(k.lower() for k in kinds))) if kinds else g.edges
    end = lambda s, k: g.nodes.select(F.col("id").alias(k), *(F.col(c).alias(f"{s}_{c}") for c in ("name", "kind", "file", "line")))
    src, dst = end("source", "src"), end("target", "dst")
    if source:
        src = src.where(F.col("source_name").rlike(source))
    if target:
        dst = dst.where(F.col("target_name").rlike(target))
    return page(e.join(src, "src").join(dst, "dst"), ["seq", "src", "dst", "kind"], offset, limit)


def location_of_id(node_id: Column) -> tuple[Column, Column]:
    """(file, line) that a generated id ``kind:file:line:col:n`` names, for nodes without a location."""
    parts = F.split(node_id, ":", 5)
    return F.when(F.size(parts) == 5, F.element_at(parts, 2)), F.when(F.size(parts) == 5, F.element_at(parts, 3).try_cast("int"))


def node_at(g: Graph, file: str, line: int) -> DataFrame:
    """The node of a line: a function before a call, a variable and others; the first emitted of equals."""
    return nodes_at(g.nodes.where((F.col("file") == file) & (F.col("line") == line)))


def nodes_at(nodes: DataFrame) -> DataFrame:
    """The chosen node of every (file, line)."""
    rank = F.coalesce(*(F.when(F.col("kind") == k, n) for k, n in PLACE_ORDER.items()), F.lit(9))
    cols = [c for c in nodes.columns if c not in ("file", "line")]
    best = nodes.groupBy("file", "line").agg(F.min_by(F.struct(*cols), F.struct(rank, "seq", "id")).alias("n"))
    return best.select("file", "line", "n.*").select(*nodes.columns)


def nodes_in_file(g: Graph, file: str) -> DataFrame:
    return g.nodes.where(F.col("file") == file).orderBy("line", "name", "seq")


def count_by_kind(df: DataFrame) -> DataFrame:
    return df.groupBy("kind").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "kind")


def files_by_extension(g: Graph) -> DataFrame:
    files = g.nodes.where("file is not null").select("file").distinct()
    return files.groupBy(extension(F.col("file")).alias("ext")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "ext")
