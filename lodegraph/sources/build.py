"""From source files to a graph: parse in parallel, derive flow and calls, rebuild what changed."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schema
from ..graph import Graph
from ..operators import calls, flow
from ..plans.fixpoint import write_out
from . import files as files_
from .emitter import Emitter

#: A front-end: (path, content) to an emitter. More languages are added here.
FRONT_ENDS: dict[str, Callable[[str, bytes], Emitter]] = {}


def front_end(language: str):
    def add(f):
        FRONT_ENDS[language] = f
        return f

    return add


@front_end("python")
def _python(path: str, content: bytes) -> Emitter:
    from .python_code import parse

    return parse(path, content)


for _lang in ("java", "javascript", "typescript", "tsx", "go", "rust", "c", "cpp"):

    def _brace(path: str, content: bytes, language: str = _lang) -> Emitter:
        from .brace_code import parse

        return parse(path, content, language)

    FRONT_ENDS[_lang] = _brace

#: Emitted rows that a task hands over at once.
ROWS_AT_ONCE = 100_000
_ROW = f"what string, path string, error string, node struct<{', '.join(x.replace(' ', ': ', 1) for x in schema.NODES.split(', '))}>, edge struct<{', '.join(x.replace(' ', ': ', 1) for x in schema.EDGES.split(', '))}>"


def parse_files(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, errors) of source files; a file that does not parse is skipped and reported.

    One task parses a file; ``seq`` orders files by path and rows within them, so it does not depend
    on how files are spread."""
    nodes_c, edges_c = schema.columns(schema.NODES), schema.columns(schema.EDGES)
    front = dict(FRONT_ENDS)

    def run(batches):
        import pandas as pd

        names = ["what", "path", "error", "node", "edge"]
        for pdf in batches:
            rows = []
            for path, language, content in zip(pdf["path"], pdf["language"], pdf["content"]):
                if language not in front:
                    continue
                try:
                    e = front[language](path, bytes(content))
                except Exception as x:  # noqa: BLE001  any parse failure skips the file
                    rows.append(("error", path, f"{type(x).__name__}: {x}", None, None))
                    continue
                rows += [("node", path, None, dict(zip(nodes_c, n)), None) for n in e.nodes]
                rows += [("edge", path, None, None, dict(zip(edges_c, n))) for n in e.edges]
                if len(rows) > ROWS_AT_ONCE:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
            yield pd.DataFrame(rows, columns=names)

    rows, _ = write_out(files.select("path", "language", "content").mapInPandas(run, _ROW), "parsed")
    out = rows.join(ranks(files.select("path").distinct()), "path")
    seq = lambda c: (F.col("rank") * F.lit(1 << 32) + F.col(f"{c}.seq")).alias("seq")
    nodes = out.where("what = 'node'").select(*(F.col(f"node.{c}") for c in nodes_c[:-1]), seq("node"))
    edges = out.where("what = 'edge'").select(*(F.col(f"edge.{c}") for c in edges_c[:-1]), seq("edge"))
    return nodes, edges, rows.where("what = 'error'").select("path", "error")


def ranks(paths: DataFrame) -> DataFrame:
    """Rows ``(path, rank)`` in order of the path: sorted by ranges, numbered within each, and moved by
    the sizes of the ranges before, so no task sees more than a range."""
    low = F.lit((1 << 33) - 1)  # ids count within a partition in their low 33 bits
    ordered = paths.repartitionByRange("path").sortWithinPartitions("path")
    numbered, _ = write_out(ordered.select("path", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(low).alias("n")), "ranks")
    sizes = numbered.groupBy("part").agg(F.count("*").alias("size"))  # a row for each range
    offsets = sizes.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("offset"))
    return numbered.join(F.broadcast(offsets), "part").select("path", (F.col("offset") + F.col("n") + 1).alias("rank"))


def derive(g: Graph, inside: bool = True, arg_order: str = "definition", cfg: bool = True, reached: Callable[[str], None] = lambda phase: None) -> Graph:
    """``g`` with control flow, calls, and data flow between functions. ``reached`` hears of each phase."""
    if cfg:
        g = g.add_edges(flow.control_flow(g.nodes))
    g = g.written()
    reached("calls")
    resolved, _ = write_out(calls.resolve_calls(g, inside).select("src", "dst", "kind"), "calls")
    reached("summaries")
    summary, _ = write_out(flow.summaries(g), "summaries")
    reached("data flow")
    between = flow.argument_flow(g, resolved, arg_order).unionByName(flow.return_flow(g, resolved, summary))
    return g.add_edges(resolved).add_edges(between)


def build(files: DataFrame, progress: Callable[[str], None] = lambda phase: None, timeout: float | None = None) -> tuple[Graph, DataFrame]:
    """(graph, errors) of source files. ``progress`` hears of each phase as it begins; a build that has
    taken more than ``timeout`` seconds by then ends in a ``TimeoutError``."""
    began = time.monotonic()

    def reached(phase: str) -> None:
        if timeout is not None and time.monotonic() - began > timeout:
            raise TimeoutError(f"the build took more than {timeout} seconds before: {phase}")
        progress(phase)

    reached("parse")
    nodes, edges, errors = parse_files(files)
    reached("control flow")
    g = derive(Graph.of(nodes, edges), reached=reached)
    reached("done")
    return g, errors


def rebuild(g: Graph, before: DataFrame, files: DataFrame) -> tuple[Graph, DataFrame, DataFrame]:
    """(graph, changes, errors): ``g`` brought up to date with ``files``, given the hashes it was built
    from. Nodes of changed and deleted files go; calls and interprocedural edges are derived again for
    all; annotations of nodes that stay are kept."""
    what, _ = write_out(files_.changes(before, files_.hashes(files)), "changes")
    old = g.nodes.join(what.select(F.col("path").alias("file")), "file", "left_semi").select("id")
    kept = g.remove_nodes(old)
    plain = kept.edges_raw.where("kind <> 'calls' and not coalesce(interprocedural, false)")
    new, edges, errors = parse_files(files.join(what.where("change <> 'deleted'").select("path"), "path", "left_semi"))
    edges = edges.unionByName(Graph.of(new, flow.control_flow(new)).edges_raw)
    base = Graph(kept.nodes.select(*schema.columns(schema.NODES)).unionByName(new.select(*schema.columns(schema.NODES))), plain.select(*schema.columns(schema.EDGES)).unionByName(edges.select(*schema.columns(schema.EDGES))), kept.node_annotations, kept.edge_annotations)
    return derive(base, cfg=False), what, errors
