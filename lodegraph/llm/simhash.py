"""Operator 5, SimHash near-duplicates by anchor points.

Two 64-bit fingerprints that differ in at most 4 bits differ in at most one bit of one of three
blocks (21, 21 and 22 bits). Anchors for a block are the words of a covering code: a Hamming(15,11)
code on its low 15 bits, all words on the others. The code's covering radius is 1, so a fingerprint's
nearest anchor, its home, is at most 1 away and a fingerprint within 1 of it lies within 2 of that
anchor. Every fingerprint is therefore replicated to each anchor within covering radius plus
threshold (1 + 1; with no more than one of the free bits changed, as a home keeps those), 14.3 anchors a block on average, and only
pairs in which the anchor is home to one are compared there.

Defined cases: a null or empty text has fingerprint zero and is linked like any other; a text of fewer
words than a shingle is one shingle; equal fingerprints are one node whatever their number; rows with
a null id keep their fingerprint and group but never become a group's id unless all are null; an empty
table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .buckets import compare_buckets, forest
from .common import arrow_map, materialize
from .components import connected_components

BLOCKS = ((0, 21), (21, 21), (42, 22))
CODE_BITS = 15
SLICE = 1 << 16


def simhash(text: bytes, width: int = 4, seed: int = 42) -> int:
    """The fingerprint of one UTF-8 text: votes of all ``width``-word shingles, repeats included."""
    words = text.lower().split()  # bytes: A-Z only, ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    start = np.cumsum(size + 1) - size - 1
    n = max(1, len(words) - width + 1)
    first, last = start[:n].tolist(), (start + size)[len(words) - n :].tolist()
    h, votes = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for k in range(0, n, SLICE):
        part = np.array([h(joined[s:e], seed) for s, e in zip(first[k : k + SLICE], last[k : k + SLICE])], np.uint64)
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(votes * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """Rows ``(id, fp)`` with the fingerprint as a signed 64-bit integer."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([simhash(t.encode() if t else b"", width) for t in batch.column(1).to_pylist()], np.uint64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return arrow_map(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run, f"id {kind}, fp long")


def _moves() -> tuple[np.ndarray, np.ndarray]:
    """By syndrome: the changes that lead to each anchor within 2 (padded with -1), home first."""
    table = np.full((16, 8), -1, np.int64)
    for s in range(16):
        near = [(1 << (s - 1)) if s else 0]
        near += [(1 << (i - 1)) | (1 << (j - 1)) for i in range(1, 16) for j in range(i + 1, 16) if i ^ j == s and s]
        table[s, : len(near)] = near
    syndrome = np.zeros(1 << CODE_BITS, np.int64)
    for i in range(CODE_BITS):
        syndrome[np.arange(1 << CODE_BITS) >> i & 1 == 1] ^= i + 1
    return table, syndrome


def anchor_rows(fps: DataFrame) -> DataFrame:
    """Rows ``(anchor, fp, home)``: each fingerprint at every anchor within covering radius plus threshold."""
    table, syndrome = _moves()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fp = batch.column(0).to_numpy()
        anchors, rows, homes = [], [], []
        for k, (low, bits) in enumerate(BLOCKS):
            part = (fp.view(np.uint64) >> np.uint64(low)).astype(np.int64) & ((1 << bits) - 1)
            near = table[syndrome[part & ((1 << CODE_BITS) - 1)]]
            home = part ^ near[:, 0]
            near = np.concatenate([np.where(near < 0, -1, part[:, None] ^ near), home[:, None] ^ (1 << np.arange(CODE_BITS, bits))], axis=1)
            row, col = np.nonzero(near >= 0)
            anchors.append(near[row, col] | (k << 40))
            rows.append(fp[row])
            homes.append(col == 0)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (anchors, rows, homes)], names=["anchor", "fp", "home"])

    return arrow_map(fps.select("fp"), run, "anchor long, fp long, home boolean")


def links(fps: DataFrame, threshold: int = 4) -> DataFrame:
    """Edges ``(a, b)`` between distinct fingerprints that span every component of the graph of pairs
    at most ``threshold`` (4 at most) bits apart. A block of pairs gives a star per component instead
    of all its pairs, so a dense group gives no more edges than it has rows."""
    if threshold > 4:
        raise ValueError("three blocks with a threshold of 1 each cover 4 differing bits at most")

    def near(cols, a, b):
        fp = cols["fp"]
        close = np.bitwise_count((fp[a] ^ fp[b]).view(np.uint64)) <= threshold
        if not close.any():
            return None
        x, y = forest(fp[a[close]], fp[b[close]])
        return pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])

    return compare_buckets(anchor_rows(fps), "anchor", "fp", "home", near, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, threshold: int = 4) -> DataFrame:
    """One row per input row: its id, ``fingerprint`` (16 hex digits) and ``component_id``, the smallest
    id of its group."""
    each = materialize(fingerprints(docs, id_col, text_col, width), "fingerprints")
    nodes = materialize(each.groupBy("fp").agg(F.min("id").alias("low")), "nodes")
    roots = materialize(connected_components(links(nodes, threshold)), "roots")
    group = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lows = group.groupBy("root").agg(F.min("low").alias("component_id"))
    of = group.join(lows, "root").select("fp", "component_id")
    return each.join(of, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
