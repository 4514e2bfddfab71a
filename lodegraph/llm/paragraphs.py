"""Operator 10, substring dedup by paragraph MinHash banding.

Paragraphs are lines of at least five words (one shingle), blocks of several lines between blank ones
(wrapped paragraphs), and passages: runs of 20 words that begin where a shingle hash is the least of 24
neighbours (winnowing), so that two texts share a passage wherever they share 43 words, whatever their
lines. All are banded by MinHash over five-word shingles: lines and blocks with as many bands as a pair
at the threshold needs to meet with the wanted probability; passages with one of many rows, since two
picked inside the same run of words are equal and meet in any band. What meets in a band is verified by exact Jaccard
similarity (equal paragraphs, told by 128 bits of two independent hashes of their characters, are one
node, with a similarity of 1) and clustered by components. A cluster stays where it stands in the
document of the smallest id and is removed from all others. Where the spans removed from a document end
with a passage, they are extended word by word as long as the document that keeps it says the same.

All pairs of a band are verified, large bands in blocks of bounded size, and a block gives a star for
each component among its pairs instead of the pairs, so dense groups give no more links than paragraphs.

Defined cases: ids are integers, or strings that hold such (others raise); a null or empty text, and one
with no line or block of 5 words, has no paragraphs; repeats within one document are left alone, as are
paragraphs that only documents with a null id hold; rows of one id are one document; letter case A-Z and
the kind of white space do not count; texts are taken whole; an empty table gives an empty result;
further columns are ignored (``find``) or carried along, whatever their names (``dedup``).
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .buckets import compare_buckets, forest
from .common import arrow_map, checked_broadcast, discard, materialize, release, unused
from .components import connected_components
from .pieces import _mix, _spread

SHINGLE, PASSAGE_WORDS, WINNOW = 5, 20, 24
#: Rows of the one band of passages: equal ones meet however many there are, and overlapping ones seldom.
PASSAGE_ROWS = 32
CHARS_AT_ONCE = 2_000_000
#: Band keys and lines in question that are broadcast at most (16 bytes each).
KEYS_AT_MOST = 1_000_000
#: Lines of a block of a large band, and shingles of sparse pairs that are looked up at once.
BLOCK_LINES, SHINGLES_AT_ONCE = 1024, 2_000_000

_BASES = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F))
_LOW = np.uint64((1 << 20) - 1)


def tune_bands(threshold: float = 0.8, recall: float = 0.99, rows: int = 4) -> int:
    """The fewest bands of ``rows`` rows in which a pair at the threshold meets with that probability."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class _Ranges:
    """Polynomial hashes of ranges of a sequence of 64-bit numbers."""

    def __init__(self, x: np.ndarray, base: np.uint64):
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * _powers(base, len(x)))])
        self.shift = _powers(np.uint64(pow(int(base), -1, 1 << 64)), len(x) + 1)

    def hash(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return _mix((self.sums[hi] - self.sums[lo]) * self.shift[lo] + (hi - lo).astype(np.uint64))


class Words:
    """The words of some texts laid end to end: hashes, places, lines."""

    def __init__(self, texts: list[str]):
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        c = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.text_start = np.cumsum(size + 1) - size - 1
        space = (c == 32) | ((c >= 9) & (c <= 13))
        edge = np.diff(np.concatenate([[True], space, [True]]).astype(np.int8))
        self.lo, self.hi = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        c = np.where((c >= 65) & (c <= 90), c + 32, c).astype(np.uint64)
        self.hash, other = (_Ranges(x, base).hash(self.lo, self.hi) for x, base in ((c + np.uint64(1), _BASES[0]), (_mix(c + np.uint64(1)), _BASES[3])))
        self.text = np.searchsorted(self.text_start, self.lo, side="right") - 1
        line = np.cumsum(c == 10)[self.lo] if len(self.lo) else self.lo
        new = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]])) if len(line) else line
        self.line_lo, self.line_hi = new, np.append(new[1:], len(line)).astype(np.int64)[: len(new)]
        apart = (line[new[1:]] - line[new[:-1]] > 1) | (self.text[new[1:]] != self.text[new[:-1]])
        head = np.flatnonzero(np.concatenate([[True], apart])) if len(new) else new
        tail = np.append(head[1:], len(new)).astype(np.int64)[: len(head)] - 1
        head, tail = head[tail > head], tail[tail > head]
        self.block_lo, self.block_hi = self.line_lo[head], self.line_hi[tail]
        self.ranges = [_Ranges(self.hash, _BASES[1]), _Ranges(other, _BASES[2])]
        self.shingle = np.zeros(0, np.uint64)
        if len(self.lo) >= SHINGLE:
            at = np.arange(len(self.lo) - SHINGLE + 1)
            self.shingle = self.ranges[0].hash(at, at + SHINGLE)

    def lines(self, least: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
        """Word ranges of the lines, and of the blocks of several lines between blank ones."""
        lo, hi = np.concatenate([self.line_lo, self.block_lo]), np.concatenate([self.line_hi, self.block_hi])
        keep = hi - lo >= least
        return lo[keep], hi[keep]

    def whole(self) -> tuple[np.ndarray, np.ndarray]:
        """Word ranges of the texts, empty ones too."""
        k = np.arange(len(self.text_start))
        return np.searchsorted(self.text, k), np.searchsorted(self.text, k, side="right")

    def units(self) -> tuple[np.ndarray, np.ndarray]:
        """Word ranges of lines and blocks, and of the passages after them."""
        (a, b), (c, d) = self.lines(), self.passages()
        return np.concatenate([a, c]), np.concatenate([b, d])

    def passages(self) -> tuple[np.ndarray, np.ndarray]:
        """Word ranges of the winnowed passages."""
        n = len(self.lo)
        if n < PASSAGE_WORDS:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.arange(n - PASSAGE_WORDS + 1)
        fits = self.text[at] == self.text[at + PASSAGE_WORDS - 1]
        value = np.where(fits, (self.shingle[: len(at)] & ~_LOW) | (at.astype(np.uint64) & _LOW), np.uint64(2**64 - 1))
        low = value
        for step in (1, 2, 4, 8, 8):  # windows of 2, 4, 8, 16 and 24 places
            low = np.minimum(low[:-step], low[step:]) if len(low) > step else low[:0]
        start = np.arange(len(low))
        whole = fits[start] & fits[start + WINNOW - 1] & (self.text[start] == self.text[start + WINNOW - 1]) if len(low) else np.zeros(0, bool)
        picked = [start[whole] + ((low[whole] - start[whole].astype(np.uint64)) & _LOW).astype(np.int64)]
        heads = np.flatnonzero(fits & np.concatenate([[True], ~fits[:-1] | (self.text[1 : len(at)] != self.text[: len(at) - 1])]))
        if len(heads):  # texts with fewer places than one window
            ends = np.searchsorted(self.text[at], self.text[heads], side="right")
            places = np.minimum(ends, len(at))
            count = np.array([int(fits[a:b].sum()) for a, b in zip(heads, places)]) if len(heads) else heads
            for h, k in zip(heads[count < WINNOW], count[count < WINNOW]):
                picked.append(np.array([h + int(np.argmin(value[h : h + k]))]))
        first = np.unique(np.concatenate(picked))
        return first, first + PASSAGE_WORDS


def _batches(ids: pa.Array, texts: list[str]):
    """(ids, Words) of some rows at a time."""
    lo = 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size + len(texts[hi]) < CHARS_AT_ONCE):
            size += len(texts[hi])
            hi += 1
        yield ids.slice(lo, hi - lo), Words(texts[lo:hi])
        lo = hi


def _line_shingles(w: Words, unit: Callable = Words.lines, only: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line hash, shingles of all lines, where each line's begin); a line of fewer words is one shingle.
    ``only``: hashes, sorted, of the lines that count, once each."""
    lo, hi = unit(w)
    line = w.ranges[0].hash(lo, hi)
    if only is not None:
        once = np.unique(line.view(np.int64), return_index=True)[1] if len(only) else np.zeros(0, np.int64)
        at = np.searchsorted(only, line[once].view(np.int64))
        once = once[only[np.minimum(at, len(only) - 1)] == line[once].view(np.int64)] if len(once) else once
        lo, hi, line = lo[once], hi[once], line[once]
    n = np.maximum(hi - lo - SHINGLE + 1, 1)
    first, short = np.cumsum(n) - n, hi - lo < SHINGLE
    at = _spread(lo, n)
    shingle = w.shingle[np.minimum(at, len(w.shingle) - 1)] if len(w.shingle) else np.zeros(len(at), np.uint64)
    shingle[first[short]] = line[short]
    return line.view(np.int64), shingle, first


def _few(threshold: float) -> int:
    """Shingles up to which only equal sets are similar enough; those meet in any band."""
    return max(n for n in range(100) if n < threshold * (n + 1)) if threshold < 0.98 else 0


class Bands:
    """MinHash band keys of sets of shingles."""

    def __init__(self, bands: int, rows: int):
        rng = np.random.default_rng(11)
        self.bands, self.rows = bands, rows
        self.mult = rng.integers(1, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.add = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64)

    def key(self, band: int, shingle: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Keys of one band for sets that begin at ``first`` in ``shingle``."""
        key = np.full(len(first), band + 1, np.uint64)
        for k in range(band * self.rows, (band + 1) * self.rows):
            key = _mix(key * _BASES[0] + np.minimum.reduceat(shingle * self.mult[k] + self.add[k], first)) if len(first) else key
        return key


def units(docs: DataFrame, threshold: float = 0.8, recall: float = 0.99, rows: int = 4) -> DataFrame:
    """Rows ``(id, h1, h2, lo, hi, passage, keys)``: every line, block and passage with its hashes, code
    point span and band keys: all bands, or one for few shingles and for passages."""
    bands, alike, few = Bands(tune_bands(threshold, recall, rows), rows), Bands(1, PASSAGE_ROWS), _few(threshold)

    def run(batch: pa.RecordBatch):
        for ids, w in _batches(batch.column(0), [x or "" for x in batch.column(1).to_pylist()]):
            lo, hi = w.units()
            if not len(lo):
                continue
            is_line = np.arange(len(lo)) < len(w.lines()[0])
            _, shingle, first = _line_shingles(w, Words.units)
            n = np.diff(np.append(first, len(shingle)))
            many = np.flatnonzero(is_line & (n > few))
            lines = int(is_line.sum())
            cut = first[lines] if lines < len(first) else len(shingle)
            part, at = shingle[:cut], first[:lines]
            keys = [bands.key(0, part, at), alike.key(0, shingle[cut:], first[lines:] - cut)]
            keys += [bands.key(b, part, at)[many] for b in range(1, bands.bands)]
            of = np.concatenate([np.arange(len(lo)), *([many] * (bands.bands - 1))])
            order = np.argsort(of, kind="stable")
            offsets = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(lo)))]).astype(np.int32)
            key_lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(keys)[order].view(np.int64)))
            h1, h2 = (r.hash(lo, hi).view(np.int64) for r in w.ranges)
            text = w.text[lo]
            base = w.text_start[text]
            cols = [ids.take(pa.array(text)), pa.array(h1), pa.array(h2), pa.array((w.lo[lo] - base).astype(np.int32)), pa.array((w.hi[hi - 1] - base).astype(np.int32)), pa.array(~is_line), key_lists]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "h1", "h2", "lo", "hi", "passage", "keys"])

    return arrow_map(docs, run, "id long, h1 long, h2 long, lo int, hi int, passage boolean, keys array<long>")


def band_rows(docs: DataFrame, bands: int, rows: int, unit: Callable = Words.lines, threshold: float = 0.8) -> DataFrame:
    """Rows ``(key, line)``: each line under the hash of each of its bands, a line of few shingles under one."""
    hashes, few = Bands(bands, rows), _few(threshold)

    def run(batch: pa.RecordBatch):
        for _, w in _batches(batch.column(0), [x or "" for x in batch.column(1).to_pylist()]):
            line, shingle, first = _line_shingles(w, unit)
            if not len(line):
                continue
            _, once = np.unique(line, return_index=True)
            more = once[np.diff(np.append(first, len(shingle)))[once] > few]
            keys = [hashes.key(b, shingle, first)[more if b else once] for b in range(bands)]
            held = [line[more if b else once] for b in range(bands)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(held))], names=["key", "line"])

    return arrow_map(docs, run, "key long, line long")


def shingle_sets(docs: DataFrame, unit: Callable = Words.lines, asked: DataFrame | None = None) -> DataFrame:
    """Rows ``(line, shingles)``: the distinct shingle hashes of each line, or of those ``asked`` for (a
    written table of distinct lines). Up to ``KEYS_AT_MOST`` of them are looked up where the shingles are
    made, 8 bytes each; more are joined."""
    few = None
    if asked is not None and asked.count() <= KEYS_AT_MOST:
        few = np.sort(asked.toArrow()["line"].to_numpy())

    def run(batch: pa.RecordBatch):
        for _, w in _batches(batch.column(0), [x or "" for x in batch.column(1).to_pylist()]):
            line, shingle, first = _line_shingles(w, unit, few)
            if not len(line):
                continue
            offsets = np.append(first, len(shingle)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(line), pa.ListArray.from_arrays(pa.array(offsets), pa.array(shingle.view(np.int64)))], names=["line", "shingles"])

    out = arrow_map(docs, run, "line long, shingles array<long>").withColumn("shingles", F.array_distinct("shingles"))
    return out if few is not None or asked is None else out.join(asked, "line")


def _similar(sets: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs (positions in ``sets``) have an exact Jaccard similarity of at least the threshold."""
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    fits = np.minimum(size[a], size[b]) >= threshold * np.maximum(size[a], size[b])
    out = np.zeros(len(a), bool)
    if not fits.any():
        return out
    rows, at = np.unique(np.concatenate([a[fits], b[fits]]), return_inverse=True)
    x, y, n = at[: len(at) // 2], at[len(at) // 2 :], size[rows]
    _, item = np.unique(np.concatenate([*sets[rows]]), return_inverse=True)
    v = int(item.max()) + 1
    if len(x) > 20 * len(rows) and len(rows) * v <= 1 << 24:  # dense: all intersections are one product
        m = np.zeros((len(rows), v), np.float32)
        m[np.repeat(np.arange(len(rows)), n), item] = 1
        common = (m @ m.T)[x, y]
    else:
        held, first = np.sort(np.repeat(np.arange(len(rows)), n) * v + item), np.cumsum(n) - n
        common = np.empty(len(x), np.int64)
        total, k = np.cumsum(n[x]), 0
        while k < len(x):
            end = max(k + 1, int(np.searchsorted(total, (total[k - 1] if k else 0) + SHINGLES_AT_ONCE, side="right")))
            p, q = x[k:end], y[k:end]
            asked = np.repeat(q * v, n[p]) + item[_spread(first[p], n[p])]
            found = held[np.minimum(np.searchsorted(held, asked), len(held) - 1)] == asked
            common[k:end] = np.add.reduceat(found, np.cumsum(n[p]) - n[p], dtype=np.int64)
            k = end
    out[fits] = common >= threshold * (n[x] + n[y] - common)
    return out


def _once(members: DataFrame) -> DataFrame:
    """``members`` (key, line) without the keys whose lines are just those of another key: two near copies
    meet in several bands, and most of those hold the two alone."""
    alike = members.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("line")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "line")).alias("y"))
    keep = alike.groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key")
    return members.join(keep, "key", "left_semi")


def line_clusters(docs: DataFrame, threshold: float = 0.8, recall: float = 0.99, rows: int = 4, unit: Callable = Words.lines, more: DataFrame | None = None, banded: DataFrame | None = None) -> DataFrame:
    """Rows ``(line, root)`` for lines (or what else ``unit`` gives) with a near-duplicate, by hash.
    ``more`` holds further rows ``(key, line)``: lines that share a key are compared as in a band.
    ``banded`` are the rows of the bands, if they are at hand."""
    if banded is None:
        banded = materialize(band_rows(docs, tune_bands(threshold, recall, rows), rows, unit, threshold), "banded")
    banded = banded if more is None else banded.unionByName(more)
    low = F.col("line").bitwiseAND(0x7FFFFFFF).cast("int")  # half a hash will do to see that two differ
    meet = materialize(banded.groupBy("key").agg(F.min(low).alias("a"), F.max(low).alias("z")).where("a < z").select("key"), "bands")
    release(banded.sparkSession)
    members = materialize(_once(materialize(banded.join(checked_broadcast(meet, KEYS_AT_MOST), "key").distinct(), "members")), "members")
    asked = materialize(members.select("line").distinct(), "lines")
    release(banded.sparkSession)
    sets = shingle_sets(docs, unit, asked).dropDuplicates(["line"])

    def verify(cols, a, b):
        keep = _similar(cols["shingles"], a, b, threshold)
        if not keep.any():
            return None
        x, y = forest(cols["line"][a[keep]], cols["line"][b[keep]])
        return pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])

    links = materialize(compare_buckets(members.join(sets, "line"), "key", "line", None, verify, "a long, b long", BLOCK_LINES, sizes=members), "links")
    release(banded.sparkSession)
    return connected_components(links).withColumnRenamed("node", "line")


def clusters(u: DataFrame, docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Rows ``(h1, h2, lead)`` of paragraphs whose cluster stands in more than one document; ``lead`` is the smallest id.

    ``u``: the paragraphs of ``docs`` as ``units`` gives them, written."""
    banded = u.select(F.explode("keys").alias("key"), F.col("h1").alias("line"))
    near = materialize(line_clusters(docs, threshold, unit=Words.units, banded=banded), "near")
    held = u.join(checked_broadcast(near, KEYS_AT_MOST), u.h1 == near.line).groupBy("h1", "h2", "root").agg(F.min("id").alias("lead"), F.max("id").alias("last"))
    held = materialize(held, "held")
    leads = held.groupBy("root").agg(F.min("lead").alias("lead"), F.max("last").alias("last")).where("lead < last").drop("last")
    similar = held.select("h1", "h2", "root").join(leads, "root").select("h1", "h2", "lead")
    equal = u.groupBy("h1", "h2").agg(F.min("id").alias("lead"), F.max("id").alias("last")).where("lead < last").select("h1", "h2", "lead")
    return equal.unionByName(similar).groupBy("h1", "h2").agg(F.min("lead").alias("lead"))


_RUN = "id long, lo int, hi int, first_h long, first_lead long, last_h long, last_lead long"


def runs(removed: DataFrame) -> DataFrame:
    """Rows ``(id, lo, hi, first_h, first_lead, last_h, last_lead)``: the union of each document's spans as
    disjoint runs, with the passages at their ends (null where a line ends them).

    ``removed``: ``(id, lo, hi, h1, lead, passage)``. A document's spans are sorted in one place; there are
    no more of them than it has paragraphs."""
    spans = removed.groupBy("id").agg(F.sort_array(F.collect_set(F.struct("lo", "hi", "passage", "h1", "lead"))).alias("s"))

    def run(batch: pa.RecordBatch):
        names = [x.split()[0] for x in _RUN.split(", ")]
        rows = []
        for doc, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            now = None
            for x in spans:
                end = (x["h1"], x["lead"]) if x["passage"] else (None, None)
                if now is None or x["lo"] > now[2]:
                    now = [doc, x["lo"], x["hi"], *end, *end]
                    rows.append(now)
                elif x["hi"] >= now[2]:
                    # of spans that end together a line ends the run
                    now[5:] = end if x["hi"] > now[2] or end[0] is None else now[5:]
                    now[2] = x["hi"]
                if x["lo"] == now[1] and not x["passage"]:
                    now[3:5] = None, None
        kinds = [pa.int64(), pa.int32(), pa.int32(), *[pa.int64()] * 4]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)

    return arrow_map(spans, run, _RUN)


def contexts(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """Rows ``(id, h, left, at, words, places)`` for each passage asked for (``id, h, left, at``) that begins
    (or ends) at ``at``, or for its first place where ``at`` is null: the hashes of up to 23 words before
    it from the nearest on (or after it), and where those begin (or end)."""
    by = asked.groupBy("id").agg(F.collect_set(F.struct("h", "left", "at")).alias("asks"))
    d = docs.join(by, "id").select("id", "text", "asks")

    def run(batch: pa.RecordBatch):
        rows = []
        for doc, text, asks in zip(*(batch.column(k).to_pylist() for k in range(3))):
            w = Words([text or ""])
            lo, hi = w.passages()
            place: dict[int, list[int]] = {}
            for j, h in enumerate(w.ranges[0].hash(lo, hi).view(np.int64).tolist()):
                place.setdefault(h, []).append(j)
            for ask in asks:
                ends = w.lo[lo] if ask["left"] else w.hi[hi - 1]
                found = place.get(ask["h"], ())
                j = next((j for j in found if ask["at"] is None or ends[j] == ask["at"]), None)
                if j is None:
                    continue
                x = np.arange(lo[j] - 1, max(lo[j] - WINNOW, -1), -1) if ask["left"] else np.arange(hi[j], min(hi[j] + WINNOW - 1, len(w.lo)))
                places = (w.lo if ask["left"] else w.hi)[x]
                rows.append((doc, ask["h"], ask["left"], ask["at"], w.hash[x].tobytes(), places.astype(np.int32).tobytes()))
            if len(rows) > 4096:
                yield batch_of(rows)
                rows = []
        if rows:
            yield batch_of(rows)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.binary(), pa.binary()
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(kinds)], names=["id", "h", "left", "at", "words", "places"])

    return arrow_map(d, run, "id long, h long, left boolean, at int, words binary, places binary")


def extended(found: DataFrame, docs: DataFrame) -> DataFrame:
    """Rows ``(id, lo, hi)``: the runs with their ends moved out as far as the words there are those of
    the document that keeps the passage at the end.

    Twenty-three words are enough: a longer shared stretch holds another passage. ``found``: as ``runs``
    gives them, written."""
    side = lambda left, h, lead, at: found.where(F.col(h).isNotNull()).select("id", "lo", "hi", F.lit(left).alias("left"), F.col(h).alias("h"), F.col(lead).alias("lead"), F.col(at).alias("at"))
    ends = side(True, "first_h", "first_lead", "lo").unionByName(side(False, "last_h", "last_lead", "hi"))
    asked = ends.select("id", "h", "left", "at").unionByName(ends.select(F.col("lead").alias("id"), "h", "left", F.lit(None).cast("int").alias("at")))
    c = materialize(contexts(docs, asked), "contexts")
    mine = c.where("at is not null").dropDuplicates(["id", "h", "left", "at"])
    theirs = c.where("at is null").select(F.col("id").alias("lead"), "h", "left", F.col("words").alias("other")).dropDuplicates(["lead", "h", "left"])
    both = ends.join(mine, ["id", "h", "left", "at"]).join(theirs, ["lead", "h", "left"]).select("id", "lo", "hi", "left", "words", "other", "places")

    def run(batch: pa.RecordBatch):
        out = []
        for words, other, places in zip(*(batch.column(k).to_pylist() for k in (4, 5, 6))):
            n = min(len(words), len(other)) // 8
            same = np.frombuffer(words, np.uint64)[:n] == np.frombuffer(other, np.uint64)[:n]
            more = n if same.all() else int(np.argmin(same))
            out.append(int(np.frombuffer(places, np.int32)[more - 1]) if more else None)
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(4)), pa.array(out, pa.int32())], names=["id", "lo", "hi", "left", "to"])

    moved = arrow_map(both, run, "id long, lo int, hi int, left boolean, to int").where("to is not null")
    moved = moved.groupBy("id", "lo", "hi").agg(F.min(F.when(F.col("left"), F.col("to"))).alias("begin"), F.max(F.when(~F.col("left"), F.col("to"))).alias("end"))
    return found.select("id", "lo", "hi").join(moved, ["id", "lo", "hi"], "left").select("id", F.coalesce("begin", "lo").alias("lo"), F.coalesce("end", "hi").alias("hi"))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8) -> DataFrame:
    """Rows ``(id, spans, leads)`` of the documents that lose something: disjoint spans in order, and the
    documents that keep what stands there."""
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    u = materialize(units(d, threshold), "units")
    dups = materialize(clusters(u, d, threshold), "dups")
    release(docs.sparkSession)
    removed = materialize(u.select("id", "h1", "h2", "lo", "hi", "passage").join(dups, ["h1", "h2"]).where("id <> lead").drop("h2"), "removed")
    discard(u)
    release(docs.sparkSession)
    found = materialize(runs(removed), "runs")
    leads = removed.groupBy("id").agg(F.sort_array(F.collect_set("lead")).alias("leads"))
    spans = extended(found, d).groupBy("id").agg(F.sort_array(F.collect_set(F.struct("lo", "hi"))).alias("s"))

    def run(batch: pa.RecordBatch):
        out = []
        for spans in batch.column(1).to_pylist():
            now: list[dict] = []
            for x in spans:  # extended runs may meet
                if now and x["lo"] <= now[-1]["hi"]:
                    now[-1]["hi"] = max(now[-1]["hi"], x["hi"])
                else:
                    now.append(x)
            out.append(now)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())])))], names=["id", "spans"])

    merged = arrow_map(spans, run, "id long, spans array<struct<lo: int, hi: int>>")
    return merged.join(leads, "id").withColumnRenamed("id", id_col)


def summary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8) -> DataFrame:
    """One row per input row: id, ``n_removed`` (characters), ``spans`` (``lo:hi`` joined by commas),
    ``repeats_of`` (ids of the documents that keep what it repeats), ``component_id`` (the smallest id that
    is reached from document to document over removed paragraphs, its own included) and ``clean``
    (nothing removed)."""
    each = materialize(find(docs, id_col, text_col, threshold), "spans")
    tied = each.select(F.col(id_col).alias("a"), F.explode("leads").alias("b"))
    component = materialize(connected_components(tied), "components").select(F.col("node").alias(id_col), "root")
    each = each.select(id_col, F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s.hi - s.lo).alias("n"), F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s.lo, s.hi)), ",").alias("spans"), "leads")
    out = docs.select(F.col(id_col).cast("long").alias(id_col)).join(each, id_col, "left").join(component, id_col, "left")
    return out.select(id_col, F.coalesce("n", F.lit(0)).alias("n_removed"), F.coalesce("spans", F.lit("")).alias("spans"), F.coalesce("leads", F.array().cast("array<long>")).alias("repeats_of"), F.coalesce("root", F.col(id_col)).alias("component_id"), F.col("n").isNull().alias("clean"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8) -> DataFrame:
    """``docs`` with the spans removed from their texts."""
    key, spans = unused(docs, "_id"), unused(docs, "_spans")
    each = find(docs, id_col, text_col, threshold).select(F.col(id_col).alias(key), F.col("spans").alias(spans))
    joined = docs.join(each, F.col(id_col).cast("long") == F.col(key), "left")
    ends = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s.hi))
    starts = F.concat(F.transform(spans, lambda s: s.lo), F.array(F.length(text_col)))
    kept = F.array_join(F.zip_with(ends, starts, lambda a, b: F.col(text_col).substr(a + 1, b - a)), "")
    return joined.withColumn(text_col, F.when(F.col(spans).isNull(), F.col(text_col)).otherwise(kept)).select(*docs.columns)
