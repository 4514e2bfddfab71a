"""Operator 8, quality rules by suffix-array repetition.

The words of a batch of texts are numbered so that no two texts share a number; one suffix array over
all of them is then the suffix arrays of each text, side by side. Prefix doubling sorts only the
suffixes that are still tied, and the classes of each doubling step give the longest common prefix of
neighbours without a loop over words. The deepest prefix interval that holds a suffix is the maximal
repeated substring that starts there; the union of those spans is what a text repeats.

Defined cases: a null or empty text has no words, fails the base rule and is not kept; a text of any
length is judged whole; repeated rows are judged alike; an empty table gives an empty result; further
columns of the input are ignored (``judge``) or carried along (``filter_documents``).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map

#: The rule's characters and the ASCII white space that ends a word; fixed values of the contract.
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
#: Words of one suffix array; a longer text is one by itself.
WORDS_AT_ONCE = 400_000


def repeat_lengths(tokens: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """For each position the length of the longest prefix of its suffix that also begins elsewhere in
    the same text. ``tokens``: word numbers, none shared by two texts; ``stops``: each position's text end."""
    n = len(tokens)
    out = np.zeros(n, np.int64)
    if not n:
        return out
    order = np.argsort(tokens, kind="stable")
    new = np.concatenate([[True], tokens[order][1:] != tokens[order][:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    tied = np.bincount(rank, minlength=n)[rank] > 1
    active, levels, k = np.flatnonzero(tied), [], 1
    first = active
    while len(active):
        levels.append(np.append(rank, -1))
        at = active + k
        second = np.where(at < stops[active], rank[np.minimum(at, n - 1)], -1)
        key = rank[active] * (n + 1) + second + 1
        by = np.argsort(key, kind="stable")
        active, key = active[by], key[by]
        head, old = np.concatenate([[True], key[1:] != key[:-1]]), rank[active]
        place = np.arange(len(active))
        group = np.maximum.accumulate(np.where(np.concatenate([[True], old[1:] != old[:-1]]), place, 0))
        inner = np.maximum.accumulate(np.where(head, place, 0))
        rank[active] = old + inner - group
        alone = head & np.append(head[1:], True)
        active, k = active[~alone], k * 2
    if not len(first):
        return out
    suffixes = np.empty(n, np.int64)
    suffixes[rank] = np.arange(n)
    r = np.sort(rank[first])
    r = r[r > 0]
    x, y = suffixes[r - 1].copy(), suffixes[r].copy()
    lcp = np.zeros(len(r), np.int64)
    for j in range(len(levels) - 1, -1, -1):
        same = levels[j][np.minimum(x, n)] == levels[j][np.minimum(y, n)]
        step = np.where(same, 1 << j, 0)
        lcp, x, y = lcp + step, x + step, y + step
    out[suffixes[r]] = lcp
    np.maximum.at(out, suffixes[r - 1], lcp)
    return out


def covered(lengths: np.ndarray, least: int, window: int | None = None) -> np.ndarray:
    """Which positions lie in a span that starts where ``lengths`` is at least ``least`` and is as long,
    or ``window`` long."""
    at = np.flatnonzero(lengths >= least)
    edge = np.zeros(len(lengths) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + (lengths[at] if window is None else window), -1)
    return np.cumsum(edge)[:-1] > 0


def _measure(texts: list[str], least: int) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_covered, longest by text."""
    number: dict = {}
    counts, tokens = np.zeros(len(texts), np.int64), []
    chars, symbols, lines_again = [], [], []
    for i, t in enumerate(texts):
        words = t.encode("utf-8", "surrogatepass").split()
        counts[i] = len(words)
        number = {}
        tokens.append(np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words)))
        chars.append(len(t) - sum(t.count(c) for c in SPACES))
        symbols.append(sum(t.count(c) for c in SYMBOLS))
        lines = [x for x in t.split("\n") if x.strip(SPACES)] if "\n" in t else []
        lines_again.append(len(lines) - len(set(lines)))
    ends = np.cumsum(counts)
    flat = np.concatenate([np.zeros(0, np.int64), *tokens])
    base = np.concatenate([[0], np.cumsum([x.max() + 1 if len(x) else 0 for x in tokens])[:-1]]) if texts else np.zeros(0, np.int64)
    flat = flat + np.repeat(base, counts)
    lengths = repeat_lengths(flat, np.repeat(ends, counts))
    of = np.repeat(np.arange(len(texts)), counts)
    total = lambda mask: np.bincount(of[mask], minlength=len(texts)).astype(np.int64)
    longest = np.zeros(len(texts), np.int64)
    np.maximum.at(longest, of, np.where(lengths >= least, lengths, 0))
    return [counts, np.array(chars, np.int64), np.array(symbols, np.int64), np.array(lines_again, np.int64), total(covered(lengths, 8, 8)), total(covered(lengths, least)), longest]


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 5, max_covered: float = 0.4, max_longest: int = 100) -> DataFrame:
    """One row per input row: the base figures, ``n_covered`` (words in maximal repeats of at least
    ``least`` words), ``longest_repeat`` (words), ``base_failed`` and ``kept``.

    A text is kept if it passes the base rule, maximal repeats cover at most ``max_covered`` of its
    words and none is longer than ``max_longest`` words."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered", "longest_repeat"]

    def run(batch: pa.RecordBatch):
        texts = [x or "" for x in batch.column(1).to_pylist()]
        lo = 0
        while lo < len(texts):
            hi, size = lo, 0
            while hi < len(texts) and (hi == lo or size + len(texts[hi]) < 6 * WORDS_AT_ONCE):
                size += len(texts[hi])
                hi += 1
            cols = _measure(texts[lo:hi], least)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *map(pa.array, cols)], names=[id_col, *names])
            lo = hi

    kind = docs.schema[id_col].dataType.simpleString()
    out = arrow_map(docs.select(id_col, text_col), run, f"`{id_col}` {kind}, " + ", ".join(f"{x} long" for x in names))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    fine = (F.col("n_covered") <= max_covered * F.col("n_words")) & (F.col("longest_repeat") <= max_longest)
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & fine)


def filter_documents(docs: DataFrame, text_col: str = "text", **rules) -> DataFrame:
    """The rows of ``docs`` whose text is kept, with their columns as they were."""
    least, max_covered, max_longest = rules.get("least", 5), rules.get("max_covered", 0.4), rules.get("max_longest", 100)
    at = docs.columns.index(text_col)

    def run(batch: pa.RecordBatch):
        texts = [x or "" for x in batch.column(at).to_pylist()]
        lo = 0
        while lo < len(texts):
            hi, size = lo, 0
            while hi < len(texts) and (hi == lo or size + len(texts[hi]) < 6 * WORDS_AT_ONCE):
                size += len(texts[hi])
                hi += 1
            n, _, _, _, again, span, longest = _measure(texts[lo:hi], least)
            keep = (n >= 20) & (100 * again <= 30 * n) & (span <= max_covered * n) & (longest <= max_longest)
            yield batch.slice(lo, hi - lo).filter(pa.array(keep))
            lo = hi

    return arrow_map(docs, run, docs.schema)
