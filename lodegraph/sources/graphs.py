"""Reading graph documents: the single JSON document, JSON lines, and plain dicts."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..graph import Graph

_LOCATION = "struct<file: string, line: int, column: int>"
_NODE = f"id string, kind string, name string, location {_LOCATION}, end_location {_LOCATION}, scope string"
_EDGE = "source string, target string, kind string"


def nodes_from_records(lines: DataFrame) -> DataFrame:
    """Node rows from one JSON record per row (``value``); ``seq`` is left null if there is none."""
    r = lines.select(F.from_json("value", _NODE).alias("r"), F.get_json_object("value", "$.attrs").alias("attrs"), *(["seq"] if "seq" in lines.columns else [F.lit(None).cast("long").alias("seq")]))
    return r.select("r.id", F.lower("r.kind").alias("kind"), "r.name", "r.location.file", "r.location.line", F.col("r.location.column").alias("col"), F.col("r.end_location.line").alias("end_line"), F.col("r.end_location.column").alias("end_col"), "r.scope", F.when(F.col("attrs") != "{}", F.col("attrs")).alias("attrs"), "seq")


def edges_from_records(lines: DataFrame) -> DataFrame:
    r = lines.select(F.from_json("value", _EDGE).alias("r"), F.get_json_object("value", "$.attrs").alias("attrs"), *(["seq"] if "seq" in lines.columns else [F.lit(None).cast("long").alias("seq")]))
    attr = lambda k: F.get_json_object("attrs", f"$.{k}")
    return r.select(F.col("r.source").alias("src"), F.col("r.target").alias("dst"), F.lower("r.kind").alias("kind"), attr("field_name").alias("field_name"), attr("interprocedural").cast("boolean").alias("interprocedural"), F.when(F.col("attrs") != "{}", F.col("attrs")).alias("attrs"), "seq")


_DOCUMENT = "struct<nodes: array<string>, edges: array<string>, annotations: map<string, map<string, string>>, edge_annotations: array<struct<source: string, target: string, annotations: map<string, string>>>>"


def from_document(text: DataFrame) -> Graph:
    """Graphs from rows ``value`` that each hold a whole document; missing parts are empty. Values of
    annotations keep their JSON form (strings are quoted again)."""
    # array<string> fields of from_json keep nested JSON as text
    d = text.select(F.from_json("value", _DOCUMENT).alias("d"))
    nodes = nodes_from_records(d.select(F.posexplode("d.nodes").alias("seq", "value")).withColumn("seq", F.col("seq").cast("long")))
    edges = edges_from_records(d.select(F.posexplode("d.edges").alias("seq", "value")).withColumn("seq", F.col("seq").cast("long")))
    is_json = lambda v: F.when(v.rlike(r'^\s*([\[{].*|true|false|null|-?[0-9.eE+-]+)\s*$'), v).otherwise(F.to_json(F.struct(v.alias("v"))).substr(F.lit(6), F.length(F.to_json(F.struct(v.alias("v")))) - 6))
    na = d.select(F.explode("d.annotations").alias("id", "m")).select("id", F.explode("m").alias("key", "value")).withColumn("value", is_json(F.col("value")))
    ea = d.select(F.explode("d.edge_annotations").alias("e")).select(F.col("e.source").alias("src"), F.col("e.target").alias("dst"), F.explode("e.annotations").alias("key", "value")).withColumn("value", is_json(F.col("value")))
    return Graph.of(nodes, edges, na, ea)


def read_json(spark: SparkSession, path: str) -> Graph:
    return from_document(spark.read.text(path, wholetext=True))


def from_dict(spark: SparkSession, document: dict) -> Graph:
    """A graph from a plain dict, on the driver; end locations, attributes and annotations may be missing."""
    nodes, edges = [], []
    for seq, n in enumerate(document.get("nodes", [])):
        loc, end = n.get("location") or {}, n.get("end_location") or {}
        if n["kind"] not in schema.NODE_KINDS:
            raise ValueError(f"unknown node kind {n['kind']!r}")
        nodes.append((n["id"], n["kind"], n.get("name"), loc.get("file"), loc.get("line"), loc.get("column"), end.get("line"), end.get("column"), n.get("scope"), json.dumps(n["attrs"]) if n.get("attrs") else None, seq))
    for seq, e in enumerate(document.get("edges", [])):
        a = e.get("attrs") or {}
        if e["kind"] not in schema.EDGE_KINDS:
            raise ValueError(f"unknown edge kind {e['kind']!r}")
        edges.append((e["source"], e["target"], e["kind"], a.get("field_name"), a.get("interprocedural"), json.dumps(a) if a else None, seq))
    notes = [(i, k, json.dumps(v), 0) for i, m in (document.get("annotations") or {}).items() for k, v in m.items()]
    pairs = [(x["source"], x["target"], k, json.dumps(v), 0) for x in document.get("edge_annotations") or [] for k, v in x["annotations"].items()]
    make = spark.createDataFrame
    return Graph.of(make(nodes, schema.NODES), make(edges, schema.EDGES), make(notes, schema.NODE_ANNOTATIONS), make(pairs, schema.EDGE_ANNOTATIONS))
