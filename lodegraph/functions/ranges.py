"""Source locations and ranges: structs ``(file, line, col)`` and ``(start, end)`` order as tuples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def location(file: Column, line: Column, col: Column) -> Column:
    return F.struct(file.alias("file"), line.alias("line"), col.alias("col"))


def contains(range_: Column, loc: Column) -> Column:
    """Whether a location lies in a range of the same file, ends included."""
    return (range_["start"]["file"] == loc["file"]) & (range_["start"] <= loc) & (loc <= range_["end"])


def overlaps(a: Column, b: Column) -> Column:
    return (a["start"]["file"] == b["start"]["file"]) & (a["start"] <= b["end"]) & (b["start"] <= a["end"])


def overlapping_pairs(ranges: DataFrame, bucket: int = 512) -> DataFrame:
    """Pairs ``a, b`` (a < b) of rows ``(id, file, lo, hi)`` whose line ranges overlap in one file.

    A range stands in each bucket of lines it touches and a pair is taken in the bucket where it
    begins to overlap, so the join key is (file, bucket) and a long file is no hot key."""
    r = ranges.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("lo") / bucket), F.floor(F.col("hi") / bucket))))
    a, b = (r.select("file", "bucket", *(F.col(c).alias(f"{c}_{s}") for c in ("id", "lo", "hi"))) for s in "ab")
    first = F.floor(F.greatest("lo_a", "lo_b") / bucket) == F.col("bucket")
    both = a.join(b, ["file", "bucket"]).where((F.col("id_a") < F.col("id_b")) & (F.col("lo_a") <= F.col("hi_b")) & (F.col("lo_b") <= F.col("hi_a")) & first)
    return both.select("file", F.col("id_a").alias("a"), F.col("id_b").alias("b"))
