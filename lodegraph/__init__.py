"""Property-graph analytics on Spark DataFrames."""

from .graph import Graph
from .operators.calls import resolve_calls
from .operators.change import annotate, diff
from .operators.filters import nodes_at, query_edges, query_nodes
from .operators.flow import control_flow, summaries
from .operators.pattern import Chain, Step, match_chain
from .operators.taint import Policy
from .operators.taint import run as run_taint
from .operators.traverse import paths_between, paths_to_sink, reachable, subgraph
from .sinks.documents import read_parquet, to_dot, to_html, to_json, write_json_lines, write_parquet
from .sources.build import build, rebuild
from .sources.emitter import Emitter
from .sources.files import inline, scan
from .sources.graphs import read_json
from .streaming.watch import watch

__all__ = [
    "Chain", "Emitter", "Graph", "Policy", "Step", "annotate", "build", "control_flow", "diff", "inline", "match_chain", "nodes_at", "paths_between", "paths_to_sink", "query_edges", "query_nodes", "reachable",
    "read_json", "read_parquet", "rebuild", "resolve_calls", "run_taint", "scan", "subgraph", "summaries", "to_dot", "to_html", "to_json", "watch", "write_json_lines", "write_parquet",
]
