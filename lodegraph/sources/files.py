"""Source trees: which files, in which language, and what changed since."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import excluded, extension, relative_path

# What a walk leaves out, and languages by file extension.
DEFAULT_EXCLUDES = ["**/__pycache__", "**/node_modules", "**/.git", "**/venv", "**/.venv"]
LANGUAGES = {
    "python": [".py", ".pyi"],
    "java": [".java"],
    "javascript": [".js", ".mjs", ".cjs"],
    "typescript": [".ts"],
    "tsx": [".tsx"],
    "go": [".go"],
    "rust": [".rs"],
    "c": [".c", ".h"],
    "cpp": [".cpp", ".cxx", ".cc", ".hpp", ".hxx", ".hh"],
}


def language_of(path: Column) -> Column:
    """The language of a path's extension; null for others."""
    table = [F.lit(x) for lang, exts in LANGUAGES.items() for e in exts for x in (e, lang)]
    return F.try_element_at(F.create_map(*table), extension(path))


def scan(spark: SparkSession, root: str, exclude: list[str] | None = None, languages: list[str] | None = None, relative_to: str | None = None, vanishing: bool = False) -> DataFrame:
    """Rows ``(path, language, content, mtime)`` of a tree's source files, paths relative to the root.

    Files of no known extension are left out; so are those that an exclude pattern matches and, if
    ``vanishing``, those deleted between listing and reading."""
    if languages and (unknown := set(languages) - set(LANGUAGES)):
        raise ValueError(f"unknown language: {', '.join(sorted(unknown))}")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreMissingFiles", vanishing).load(root)
    base = relative_to or root
    path = F.regexp_replace("path", "^file:/*(?=/)", "")
    out = found.select(relative_path(path, base.removeprefix("file://")).alias("path"), "content", F.col("modificationTime").alias("mtime"))
    out = out.where(~excluded(F.col("path"), DEFAULT_EXCLUDES if exclude is None else [*DEFAULT_EXCLUDES, *exclude]))
    out = out.withColumn("language", language_of(F.col("path"))).where("language is not null")
    if languages:
        out = out.where(F.col("language").isin(*languages))
    return out.select("path", "language", "content", "mtime")


def inline(spark: SparkSession, sources: dict[str, str | bytes], language: str | None = None) -> DataFrame:
    """Rows as ``scan`` gives them, for source texts by file name."""
    rows = [(name, bytearray(s if isinstance(s, bytes) else s.encode())) for name, s in sources.items()]
    out = spark.createDataFrame(rows, "path string, content binary")
    lang = F.lit(language) if language else language_of(F.col("path"))
    return out.select("path", lang.alias("language"), "content", F.lit(None).cast("timestamp").alias("mtime")).where("language is not null")


def hashes(files: DataFrame) -> DataFrame:
    """Rows ``(path, hash)``: SHA-256 of each file's content."""
    return files.select("path", F.sha2("content", 256).alias("hash"))


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows ``(path, change)``: ``added``, ``changed`` or ``deleted`` between two snapshots of hashes."""
    a, b = before.select("path", F.col("hash").alias("h1")), after.select("path", F.col("hash").alias("h2"))
    what = F.when(F.col("h1").isNull(), "added").when(F.col("h2").isNull(), "deleted").when(F.col("h1") != F.col("h2"), "changed")
    return a.join(b, "path", "full_outer").select("path", what.alias("change")).where("change is not null")
