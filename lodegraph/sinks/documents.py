"""Graphs as documents: Parquet, JSON, DOT, HTML, tables."""

from __future__ import annotations

import html as _html
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import dot_escape
from ..graph import Graph

VERSION = "1.0"
_PARTS = ("nodes", "edges_raw", "node_annotations", "edge_annotations")


def write_parquet(g: Graph, path: str, mode: str = "error") -> None:
    """The native form; nodes and edges are partitioned by kind, which filters by kind then prune."""
    for part in _PARTS:
        w = getattr(g, part).write.mode(mode)
        (w.partitionBy("kind") if part in ("nodes", "edges_raw") else w).parquet(f"{path}/{part}")


def read_parquet(spark: SparkSession, path: str) -> Graph:
    return Graph.of(*(spark.read.parquet(f"{path}/{part}") for part in _PARTS))


def _loc(line: str, col: str) -> Column:
    return F.when(F.col(line).isNotNull() & F.col("file").isNotNull(), F.struct("file", F.col(line).alias("line"), F.col(col).alias("column")))


def node_records(nodes: DataFrame) -> DataFrame:
    """One JSON record per node, ``json``, with ``seq``."""
    raw = F.to_json(F.struct("id", "kind", "name", _loc("line", "col").alias("location"), _loc("end_line", "end_col").alias("end_location"), "scope"), {"ignoreNullFields": "false"})
    body = F.concat(raw.substr(F.lit(1), F.length(raw) - 1), F.lit(', "attrs": '), F.coalesce("attrs", F.lit("{}")), F.lit("}"))
    return nodes.select("seq", "id", body.alias("json"))


def edge_records(edges: DataFrame) -> DataFrame:
    attrs = F.coalesce("attrs", F.to_json(F.struct("field_name", "interprocedural")))
    raw = F.to_json(F.struct(F.col("src").alias("source"), F.col("dst").alias("target"), "kind"))
    return edges.select("seq", "src", "dst", "kind", F.concat(raw.substr(F.lit(1), F.length(raw) - 1), F.lit(', "attrs": '), attrs, F.lit("}")).alias("json"))


#: Nodes, and edges, that one JSON document may hold.
DOCUMENT_ROWS = 1_000_000


def to_json(g: Graph) -> str:
    """The single-document form, on the driver: for graphs that a person looks at. A graph of more than
    ``DOCUMENT_ROWS`` nodes or edges is an error; those go to ``write_json_lines`` or Parquet."""
    for name, df in (("nodes", g.nodes), ("edges", g.edges_raw)):
        if df.limit(DOCUMENT_ROWS + 1).count() > DOCUMENT_ROWS:
            raise ValueError(f"more than {DOCUMENT_ROWS} {name}: write Parquet or JSON lines instead of one document")
    lines = lambda df, *by: [json.loads(r.json) for r in df.orderBy(*by).select("json").toLocalIterator()]
    notes: dict = {}
    for r in g.node_annotations.orderBy("id", "key").toLocalIterator():
        notes.setdefault(r.id, {})[r.key] = json.loads(r.value)
    pairs: dict = {}
    for r in g.edge_annotations.orderBy("src", "dst", "key").toLocalIterator():
        pairs.setdefault((r.src, r.dst), {})[r.key] = json.loads(r.value)
    document = {"version": VERSION, "nodes": lines(node_records(g.nodes), "seq", "id"), "edges": lines(edge_records(g.edges), "seq", "src", "dst", "kind"), "annotations": notes}
    document["edge_annotations"] = [{"source": s, "target": t, "annotations": a} for (s, t), a in pairs.items()]
    return json.dumps(document, indent=2)


def write_json_lines(g: Graph, path: str) -> None:
    node_records(g.nodes).select(F.col("json").alias("value")).write.text(f"{path}/nodes")
    edge_records(g.edges).select(F.col("json").alias("value")).write.text(f"{path}/edges")


# Graphviz shapes by node kind and styles by edge kind.
SHAPES = {"module": "folder", "class": "component", "function": "box", "parameter": "ellipse", "variable": "ellipse", "call": "diamond", "literal": "plaintext", "return": "invhouse", "import": "note", "branch": "hexagon", "loop": "octagon", "block": "box"}
STYLES = {"contains": "dashed", "has_parameter": "dashed", "has_return_type": "dashed", "flows_to": "solid", "branches_to": "bold", "data_flows_to": "solid", "defined_by": "dotted", "used_by": "dotted", "calls": "bold", "resolves_to": "dotted", "imports": "dashed"}


def _lookup(table: dict[str, str], key: Column, default: str) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key), F.lit(default))


def dot_lines(g: Graph, edge_kinds: list[str] | None = None, node_kinds: list[str] | None = None) -> DataFrame:
    """Rows ``(part, line)`` of a DOT document. An edge filter drops nodes that no kept edge touches; a
    node filter drops nodes but not their edges."""
    edges, nodes = g.edges, g.nodes
    if edge_kinds:
        edges = edges.where(F.col("kind").isin(*edge_kinds))
        touched = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()
        nodes = nodes.join(touched, "id", "left_semi")
    if node_kinds:
        nodes = nodes.where(F.col("kind").isin(*node_kinds))
    label = F.concat("kind", F.lit(": "), dot_escape(F.col("name")), F.when(F.col("line").isNotNull(), F.concat(F.lit("\\nL"), F.col("line").cast("string"))).otherwise(""))
    n = nodes.select(F.lit(1).alias("part"), F.concat(F.lit('  "'), dot_escape(F.col("id")), F.lit('" [label="'), label, F.lit('", shape='), _lookup(SHAPES, F.col("kind"), "box"), F.lit("];")).alias("line"))
    e = edges.select(F.lit(2).alias("part"), F.concat(F.lit('  "'), dot_escape(F.col("src")), F.lit('" -> "'), dot_escape(F.col("dst")), F.lit('" [label="'), F.col("kind"), F.lit('", style='), _lookup(STYLES, F.col("kind"), "solid"), F.lit("];")).alias("line"))
    frame = g.spark.createDataFrame([(0, "digraph G {\n  rankdir=LR;"), (3, "}")], "part int, line string")
    return frame.unionByName(n).unionByName(e)


def to_dot(g: Graph, **filters) -> str:
    return "\n".join(r.line for r in dot_lines(g, **filters).orderBy("part", "line").toLocalIterator()) + "\n"


def html_elements(g: Graph, exclude_kinds: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) as display elements; edges of excluded nodes go too."""
    nodes = g.nodes.where(~F.col("kind").isin(*exclude_kinds)) if exclude_kinds else g.nodes
    ids = nodes.select("id")
    edges = g.edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi")
    n = nodes.select(F.to_json(F.struct(F.struct("id", F.col("name").alias("label"), "kind", "file", "line").alias("data"))).alias("json"))
    e = edges.select(F.to_json(F.struct(F.struct(F.col("src").alias("source"), F.col("dst").alias("target"), "kind").alias("data"))).alias("json"))
    return n, e


_PAGE = """<!DOCTYPE html><html><head><meta charset="utf-8"><title>%(title)s</title><style>
body{font:14px sans-serif;margin:0;display:flex}aside{width:240px;padding:12px;background:#f4f4f4;height:100vh;overflow:auto}svg{flex:1;height:100vh}
line{stroke:#999}.n{stroke:#333}text{font-size:10px}</style></head><body><aside><h1>%(title)s</h1><div id="stats">%(stats)s</div><div id="layers"></div><div id="overlays"></div></aside><svg id="g"></svg><script>
const nodes=%(nodes)s,edges=%(edges)s,layers=%(layers)s,styles=%(styles)s;
const svg=document.getElementById("g"),at={},ns="http://www.w3.org/2000/svg",side=Math.ceil(Math.sqrt(nodes.length));
const add=(t,a,x)=>{const e=document.createElementNS(ns,t);for(const k in a)e.setAttribute(k,a[k]);if(x)e.textContent=x;svg.appendChild(e);return e};
nodes.forEach((n,i)=>at[n.data.id]=[40+(i%%side)*90,40+Math.floor(i/side)*60]);
const overlays=%(overlays)s,on=new Set(overlays.filter(o=>o.visible!==false).map(o=>o.name)),own={};
overlays.forEach(o=>{own[o.name]={};(o.edges||[]).forEach(e=>own[o.name][e.source+"\\0"+e.target]=e)});
const styleOf=(id,edge)=>Object.assign({},edge?{}:styles[id],...overlays.filter(o=>on.has(o.name)).map(o=>(edge?own[o.name]:o.nodes||{})[id]||{}));
const dash={dashed:"6,4",dotted:"2,3"},corners={square:4,diamond:4,triangle:3,hexagon:6,octagon:8},turn={square:Math.PI/4,triangle:-Math.PI/2};
const draw=()=>{svg.innerHTML="";
edges.forEach(e=>{const p=at[e.data.source],q=at[e.data.target],s=styleOf(e.data.source+"\\0"+e.data.target,1);add("line",{x1:p[0],y1:p[1],x2:q[0],y2:q[1],style:"stroke:"+(s.color||"#999")+";stroke-width:"+(s.width||1),"stroke-dasharray":dash[s.style]||"",opacity:s.opacity??1,"data-kind":e.data.kind});if(s.label)add("text",{x:(p[0]+q[0])/2,y:(p[1]+q[1])/2},s.label)});
nodes.forEach(n=>{const p=at[n.data.id],s=styleOf(n.data.id),r=s.size||6,k=corners[s.shape],a={class:"n",fill:s.color||"#8ac",opacity:s.opacity??1,"data-kind":n.data.kind};
if(k)add("polygon",{...a,points:[...Array(k).keys()].map(i=>{const w=(turn[s.shape]||0)+i*2*Math.PI/k;return (p[0]+r*Math.cos(w))+","+(p[1]+r*Math.sin(w))}).join(" ")});else add("circle",{...a,cx:p[0],cy:p[1],r});
add("text",{x:p[0]+8,y:p[1]+4,"data-kind":n.data.kind},s.label||n.data.label)})};draw();
overlays.forEach(o=>{const b=document.createElement("label"),c=document.createElement("input");c.type="checkbox";c.checked=on.has(o.name);c.onchange=()=>{c.checked?on.add(o.name):on.delete(o.name);draw()};b.append(c,o.name);document.getElementById("overlays").append(b,document.createElement("br"))});
layers.forEach(l=>{const b=document.createElement("label"),c=document.createElement("input");c.type="checkbox";c.checked=l.visible!==false;const show=()=>svg.querySelectorAll("[data-kind]").forEach(e=>{if((l.kinds||[]).includes(e.dataset.kind))e.style.display=c.checked?"":"none"});c.onchange=show;b.append(c,l.name);document.getElementById("layers").append(b,document.createElement("br"));show()});
</script></body></html>
"""
DEFAULT_LAYERS = [{"name": "Structure", "kinds": ["contains", "has_parameter"], "visible": True}, {"name": "Control flow", "kinds": ["flows_to", "branches_to"], "visible": True}, {"name": "Data flow", "kinds": ["data_flows_to", "defined_by", "used_by"], "visible": True}, {"name": "Calls", "kinds": ["calls", "resolves_to"], "visible": True}, {"name": "Imports", "kinds": ["import", "imports"], "visible": False}]


def to_html(g: Graph, title: str = "Graph", exclude_kinds: list[str] | None = None, layers: list[dict] | None = None, overlay: dict[str, dict] | None = None, overlays: list[dict] | None = None) -> str:
    """A page of its own with the graph, layer switches and styles; for graphs a person can look at.

    ``layers`` (name, kinds of edges or nodes, visible) and ``overlays`` (name, visible, ``nodes``: style by id,
    ``edges``: dicts of source, target and style) get switches; ``overlay`` holds styles by node id that always
    apply. A node's style: color, size, shape (circle, square, diamond, triangle, hexagon, octagon), label,
    opacity; an edge's: color, width, style (solid, dashed, dotted), label, opacity. Later overlays win."""
    n, e = html_elements(g, exclude_kinds)
    safe = lambda x: x.replace("</", "<\\/")
    array = lambda df: safe("[" + ",".join(r.json for r in df.toLocalIterator()) + "]")
    stats = "".join(f"<div>{r.kind}: {r['n']}</div>" for r in g.nodes.groupBy("kind").agg(F.count("*").alias("n")).orderBy("kind").toLocalIterator())
    return _PAGE % {"title": _html.escape(title), "stats": stats, "nodes": array(n), "edges": array(e), "layers": safe(json.dumps(layers or DEFAULT_LAYERS)), "styles": safe(json.dumps(overlay or {})), "overlays": safe(json.dumps(overlays or []))}


def format_rows(df: DataFrame, kind: str = "table") -> str:
    """Rows as ``table``, ``json``, ``jsonl``, ``csv`` or ``tsv`` text, for the command line."""
    rows, names = [r.asDict() for r in df.toLocalIterator()], df.columns
    if kind == "json":
        return json.dumps(rows, indent=2, default=str)
    if kind == "jsonl":
        return "\n".join(json.dumps(r, default=str) for r in rows)
    if kind in ("csv", "tsv"):
        import csv
        import io

        out = io.StringIO()
        w = csv.writer(out, delimiter="," if kind == "csv" else "\t", lineterminator="\n")
        w.writerow(names)
        w.writerows([["" if r[c] is None else r[c] for c in names] for r in rows])
        return out.getvalue().rstrip("\n")
    text = [names, *([("" if r[c] is None else str(r[c])) for c in names] for r in rows)]
    width = [max(len(r[i]) for r in text) for i in range(len(names))]
    return "\n".join("  ".join(x.ljust(w) for x, w in zip(r, width)).rstrip() for r in text)
