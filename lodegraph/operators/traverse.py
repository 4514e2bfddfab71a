"""Reachability, subgraphs and path enumeration over edge tables.

Closures run breadth first over (origin, node) rows with duplicates dropped each round, for any number
of origins at once; paths are only enumerated up to a cutoff."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from ..plans.fixpoint import fixpoint, write_out


def hops(g: Graph, kinds: list[str] | None = None, reverse: bool = False) -> DataFrame:
    """Distinct ``(src, dst)`` of edges of the kinds, turned round if asked."""
    e = g.edges_raw.where(F.col("kind").isin(*kinds)) if kinds else g.edges_raw
    a, b = ("dst", "src") if reverse else ("src", "dst")
    return e.select(F.col(a).alias("src"), F.col(b).alias("dst")).distinct()


def reach(edges: DataFrame, origins: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Rows ``(origin, node, depth)`` reached over at least one edge; depth is the shortest distance."""
    e, _ = write_out(edges.select("src", "dst"), "hops")
    one = origins.select(F.col("id").alias("origin")).distinct()
    seed = one.join(e, one.origin == e.src).select("origin", F.col("dst").alias("node"), F.lit(1).alias("depth"))
    step = lambda d: d.join(e, d.node == e.src).select("origin", F.col("dst").alias("node"), (F.col("depth") + 1).alias("depth"))
    return fixpoint(seed, step, ["origin", "node"], None if max_depth is None else max(0, max_depth - 1))


def reachable(g: Graph, origins: DataFrame, kinds: list[str] | None = None, reverse: bool = False, include_start_on_cycle: bool | None = None) -> DataFrame:
    """Nodes reached from each origin. A start on a cycle counts as reached where kinds are given and
    not otherwise, unless ``include_start_on_cycle`` says so."""
    found = reach(hops(g, kinds, reverse), origins)
    keep = bool(kinds) if include_start_on_cycle is None else include_start_on_cycle
    if not keep:
        found = found.where("origin <> node")
    return found.join(g.nodes, F.col("node") == F.col("id")).drop("node")


def subgraph(g: Graph, root: str, kinds: list[str] | None = None, max_depth: int = 10) -> Graph:
    """What lies within ``max_depth`` hops of the root, the edges (of the kinds) between those nodes,
    and the nodes' annotations."""
    start = g.node(root).select("id")
    found = reach(hops(g, kinds), start, max_depth).select(F.col("node").alias("id")) if max_depth > 0 else start
    ids, _ = write_out(found.unionByName(start).distinct(), "inside")
    nodes = g.nodes.join(ids, "id", "left_semi")
    e = g.edges_raw.where(F.col("kind").isin(*kinds)) if kinds else g.edges_raw
    e = e.join(nodes.select(F.col("id").alias("src")), "src", "left_semi").join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi")
    return Graph.of(nodes, e, g.node_annotations.join(ids, "id", "left_semi"))


def _extend(edges: DataFrame, paths: DataFrame) -> DataFrame:
    """Paths longer by one node that is not on them yet."""
    on = paths.join(edges, paths.at == edges.src).where(~F.array_contains("path", F.col("dst")))
    return on.select(F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("at"))


def simple_paths(edges: DataFrame, start: DataFrame, ends: DataFrame, cutoff: int) -> DataFrame:
    """Simple paths ``(path)`` of 1 to ``cutoff`` edges from any row of ``start`` to any of ``ends``.

    Only edges on some short enough way are walked: a backward closure from the ends bounds the rest."""
    back = reach(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ends, cutoff)
    near = back.groupBy("node").agg(F.min("depth").alias("left")).unionByName(ends.select(F.col("id").alias("node"), F.lit(0).alias("left")))
    near, _ = write_out(near.groupBy("node").agg(F.min("left").alias("left")), "near")
    paths = start.select(F.array("id").alias("path"), F.col("id").alias("at"))
    out = None
    for n in range(1, cutoff + 1):
        paths = _extend(edges, paths).join(near, F.col("at") == F.col("node")).where(F.col("left") <= cutoff - n).select("path", "at")
        paths, _ = write_out(paths, "paths")
        hit = paths.join(ends.select(F.col("id").alias("at")), "at", "left_semi").select("path")
        out = hit if out is None else out.unionByName(hit)
        if paths.isEmpty():
            break
    return out if out is not None else paths.select("path").limit(0)


def paths_between(g: Graph, src: str, dst: str, cutoff: int = 10) -> DataFrame:
    """Simple node paths from ``src`` to ``dst`` of at most ``cutoff`` edges of any kind; empty if either is missing."""
    return simple_paths(hops(g), g.node(src).select("id"), g.node(dst).select("id"), cutoff)


def paths_to_sink(g: Graph, sink: str, kinds: list[str] | None = None, cutoff: int = 20) -> DataFrame:
    """Simple paths to the sink from every node within reach that has no predecessor within reach."""
    e, _ = write_out(hops(g, kinds), "hops")
    end = g.node(sink).select("id")
    back = reach(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")), end, cutoff).select(F.col("node").alias("id"))
    inside, _ = write_out(back.unionByName(end).distinct(), "inside")
    e = e.join(inside.select(F.col("id").alias("src")), "src", "left_semi").join(inside.select(F.col("id").alias("dst")), "dst", "left_semi")
    e, _ = write_out(e, "induced")
    roots = inside.join(e.select(F.col("dst").alias("id")), "id", "left_anti").where(F.col("id") != sink)
    return simple_paths(e, roots, end, cutoff)
