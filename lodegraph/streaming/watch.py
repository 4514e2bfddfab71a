"""Keeping a graph up to date with a source tree."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import Graph
from ..plans.fixpoint import remove, write_out
from ..sinks.documents import read_parquet, write_parquet
from ..sources import build as build_
from ..sources import files as files_


def snapshot(spark: SparkSession, root: str, exclude: list[str] | None = None) -> DataFrame:
    """Rows ``(path, mtime)`` of a tree's source files."""
    return files_.scan(spark, root, exclude).select("path", "mtime")


def save(g: Graph, files: DataFrame, path: str, version: int) -> None:
    """Write version ``version`` of a graph and the hashes it was built from. A version is never
    written over, so a reader of an older one is not disturbed."""
    write_parquet(g, f"{path}/v{version}")
    files_.hashes(files).write.parquet(f"{path}/v{version}/hashes")


def update(spark: SparkSession, root: str, path: str, version: int, exclude: list[str] | None = None) -> DataFrame | None:
    """Build version ``version + 1`` from what changed in the tree; None if nothing did."""
    files, path_of_files = write_out(files_.scan(spark, root, exclude, vanishing=True), "tree")  # read once: files may change meanwhile
    before = spark.read.parquet(f"{path}/v{version}/hashes")
    if files_.changes(before, files_.hashes(files)).isEmpty():
        remove(spark, path_of_files)
        return None
    g, what, _ = build_.rebuild(read_parquet(spark, f"{path}/v{version}"), before, files)
    save(g, files, path, version + 1)
    remove(spark, path_of_files)
    return what


def latest(spark: SparkSession, path: str) -> int | None:
    """The last version that was written whole, or None."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/v*/hashes/_SUCCESS")
    found = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).globStatus(at) or []
    return max((int(f.getPath().getParent().getParent().getName()[1:]) for f in found), default=None)


def watch(spark: SparkSession, root: str, path: str, checkpoint: str, exclude: list[str] | None = None, every: str = "2 seconds", once: bool = False, told: Callable[[DataFrame], None] = lambda changes: None):
    """A streaming query that at every trigger compares the tree's hashes with those of the last version
    and builds the next one from what was added, edited or deleted. Returns the query.

    A source of clock ticks drives it, as a stream of files would know files by their path and never see
    one edited or deleted. Without a version at ``path`` the first one is built at once. Each rebuild runs
    on a thread of its own, since the stream's has too small a stack for its plans."""
    version = [latest(spark, path)]
    if version[0] is None:
        files, _ = write_out(files_.scan(spark, root, exclude, vanishing=True), "tree")
        save(build_.build(files)[0], files, path, 0)
        version[0] = 0

    def rebuild(failed: list[Exception]) -> None:
        try:
            if (what := update(spark, root, path, version[0], exclude)) is not None:
                version[0] += 1
                told(what)
        except Exception as x:  # noqa: BLE001  raised again on the stream's thread
            failed.append(x)

    def batch(ticks: DataFrame, number: int) -> None:
        failed: list[Exception] = []
        worker = threading.Thread(target=rebuild, args=(failed,))
        worker.start()
        worker.join()
        if failed:
            raise failed[0]

    ticks = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).option("numPartitions", 1).load()
    out = ticks.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out.trigger(processingTime=every)).start()
