"""Near-duplicate documents by exact Jaccard similarity of their five-word shingles.

Two texts are compared where they share a MinHash band (as many bands as a pair at the threshold needs
to meet with the wanted probability) or a component of SimHash links over the same shingles (operator
5's anchors). A similarity of 0.8 leaves 64-bit fingerprints about 10 bits apart, often 16 and more,
which no anchors reach with selective groups; so the links alone do not do. Whatever meets is verified
exactly and clustered by components.

Defined cases: those of operator 5; equal texts, letter case A-Z and the kind of white space aside, are
one node whatever their number, empty and null ones too.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, materialize
from .components import connected_components
from .paragraphs import SHINGLE, Words, _batches, line_clusters
from .simhash import links, simhash


def _nodes(docs: DataFrame) -> DataFrame:
    """Rows ``(id, line, fp)``: the hash and the fingerprint of each text."""

    def run(batch: pa.RecordBatch):
        texts = [x or "" for x in batch.column(1).to_pylist()]
        at = 0
        for ids, w in _batches(batch.column(0), texts):
            line = w.ranges[0].hash(*w.whole()).view(np.int64)
            fp = np.array([simhash(t.encode(), SHINGLE) for t in texts[at : at + len(ids)]], np.uint64).view(np.int64)
            at += len(ids)
            yield pa.RecordBatch.from_arrays([ids, pa.array(line), pa.array(fp)], names=["id", "line", "fp"])

    return arrow_map(docs, run, f"id {docs.schema['id'].dataType.simpleString()}, line long, fp long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, recall: float = 0.9999) -> DataFrame:
    """One row per input row: its id and ``component_id``, the smallest id of its group."""
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    each = materialize(_nodes(d), "texts")
    nodes = materialize(each.groupBy("line", "fp").agg(F.min("id").alias("low")), "nodes")
    roots = materialize(connected_components(links(nodes.select("fp").distinct())), "roots")
    linked = nodes.join(roots, nodes.fp == roots.node, "left").select(F.coalesce("root", "fp").alias("key"), "line")
    near = materialize(line_clusters(d, threshold, recall, unit=Words.whole, more=linked), "near").withColumnRenamed("line", "node")
    group = nodes.join(near, nodes.line == near.node, "left").select("line", "low", F.coalesce("root", "line").alias("root"))
    lows = group.groupBy("root").agg(F.min("low").alias("component_id"))
    return each.join(group.join(lows, "root").select("line", "component_id"), "line").select(F.col("id").alias(id_col), "component_id")
