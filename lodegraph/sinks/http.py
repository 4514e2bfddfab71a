"""A read-only JSON API over a graph, for people and small tools."""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, unquote, urlparse

from pyspark.sql import functions as F

from ..graph import Graph
from ..operators import filters, traverse
from ..schema import EDGE_KINDS, NODE_KINDS


class NotFound(Exception):
    pass


def _rows(df) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.toLocalIterator()]


def answer(g: Graph, target: str):
    """The answer to one request, by path and query string."""
    url = urlparse(target)
    q = {k: v[-1] for k, v in parse_qs(url.query).items()}
    number = lambda k, d: int(q.get(k, d))
    if q.get("kind") and q["kind"].lower() not in NODE_KINDS + EDGE_KINDS:
        raise ValueError(f"unknown kind {q['kind']!r}")
    kinds = [q["kind"]] if q.get("kind") else None
    if url.path == "/health":
        return {"status": "ok"}
    if url.path == "/info":
        return _rows(g.counts())[0] | {"nodes_by_kind": {r["kind"]: r["n"] for r in _rows(filters.count_by_kind(g.nodes))}, "edges_by_kind": {r["kind"]: r["n"] for r in _rows(filters.count_by_kind(g.edges))}}
    if url.path == "/query":
        return {"nodes": _rows(filters.query_nodes(g, kinds, q.get("name"), q.get("file"), limit=number("limit", 50)))}
    if url.path.startswith("/node/"):
        found = _rows(g.node(unquote(url.path[len("/node/") :])))
        if not found:
            raise NotFound("no such node")
        notes = g.annotations_for(g.node(found[0]["id"]))
        return found[0] | {"annotations": {r["key"]: json.loads(r["value"]) for r in _rows(notes)}}
    if url.path == "/edges":
        e = g.edges_of(kinds[0].lower() if kinds else None)
        for c, k in (("src", "source"), ("dst", "target")):
            if q.get(k):
                e = e.where(F.col(c) == q[k])
        return {"edges": _rows(filters.page(e, ["seq", "src", "dst", "kind"], 0, number("limit", 200)))}
    if url.path == "/subgraph":
        if not q.get("root"):
            raise ValueError("root is missing")
        if not g.has_node(q["root"]):
            raise NotFound("no such node")
        s = traverse.subgraph(g, q["root"], max_depth=number("depth", 10))
        return {"nodes": _rows(s.nodes), "edges": _rows(s.edges)}
    raise NotFound("no such path")


def server(g: Graph, host: str = "127.0.0.1", port: int = 8080) -> ThreadingHTTPServer:
    g.nodes.cache()
    g.edges_raw.cache()

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:  # noqa: N802
            try:
                status, body = 200, answer(g, self.path)
            except NotFound as x:
                status, body = 404, {"error": "not_found", "message": str(x)}
            except ValueError as x:
                status, body = 400, {"error": "bad_request", "message": str(x)}
            except Exception as x:  # noqa: BLE001  a request's failure is its answer
                status, body = 500, {"error": type(x).__name__, "message": str(x)[:500]}
            data = json.dumps(body, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
