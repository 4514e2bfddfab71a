"""String and path helpers as columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """``.py`` of ``a/b.py``; empty without one."""
    return F.regexp_extract(basename(path), r"(\.[^.]*)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def short_name(name: Column) -> Column:
    """What follows the last ``.`` or ``::``."""
    return F.substring_index(F.substring_index(name, "::", -1), ".", -1)


def qualifier(name: Column) -> Column:
    """The segment before the last one; null without."""
    parts = F.split(F.replace(name, F.lit("::"), F.lit(".")), r"\.")
    return F.when(F.size(parts) > 1, F.element_at(parts, -2))


def without_generics(name: Column) -> Column:
    return F.regexp_replace(name, r"[\[<].*", "")


def normalised_path(path: Column, prefix: str | None = None) -> Column:
    """Without the prefix where it begins with it; else (or without one) the base name."""
    if not prefix:
        return basename(path)
    p = prefix.rstrip("/") + "/"
    return F.when(F.startswith(path, F.lit(p)), F.substring(path, len(p) + 1, 1 << 30)).otherwise(basename(path))


def relative_path(path: Column, root: str) -> Column:
    """Relative to the root; a path outside stays as it is."""
    p = root.rstrip("/") + "/"
    return F.when(F.startswith(path, F.lit(p)), F.substring(path, len(p) + 1, 1 << 30)).otherwise(path)


def glob_regex(pattern: str) -> str:
    """An anchored regular expression of a shell pattern; ``*`` also matches ``/``."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        end = pattern.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif end > 0:
            body = pattern[i + 1 : end]
            out += "[" + ("^" + body[1:] if body[0] == "!" else body) + "]"
            i = end
        else:
            out += re.escape(c)
        i += 1
    return f"^{out}$"


def excluded(path: Column, patterns: list[str]) -> Column:
    """Whether the relative path, or any part of it, matches a pattern (a leading ``**/`` does not count)."""
    test = F.lit(False)
    for p in patterns:
        whole, part = glob_regex(p), glob_regex(p[3:] if p.startswith("**/") else p)
        test = test | path.rlike(whole) | _any_part(path, part)
    return test


def _any_part(path: Column, regex: str) -> Column:
    return F.exists(F.split(path, "/"), lambda x: x.rlike(regex))


def dot_escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(out, F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
