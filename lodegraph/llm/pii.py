"""Operator 9, personal data behind disguises, with spans in the source text.

Base detectors run over the text as it is. Then a chain of transducers rewrites disguises (look-alike
characters, at/dot spellings, digits as words) and keeps, for every character it emits, the span of
source characters it stands for; the detectors run again over the rewritten text and what they find is
mapped back; nine to fifteen digits that are all words count as a phone number without a plus too. A
found span is added unless another span covers it whole.

Defined cases: a null or empty text has no spans; texts are searched whole, in time that grows with
their length; repeated rows give the same spans; an empty table gives an empty result; further columns
are ignored (``find``) or carried along (``redact``).
"""

from __future__ import annotations

import hashlib
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_map

KINDS = ("email", "ip", "card", "phone")

_LEFT = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def emails(t: str) -> list[tuple[int, int]]:
    out, floor = [], 0
    at = t.find("@")
    while at >= 0:
        start = at
        while start > floor and _LEFT.match(t, start - 1):
            start -= 1
        m = _DOMAIN.match(t, at) if start < at else None
        if m:
            out.append((start, m.end()))
        floor = m.end() if m else at + 1
        at = t.find("@", floor)
    return out


def ips(t: str) -> list[tuple[int, int]]:
    """Groups of four dot-separated numbers, from the left of each run of them."""
    out = []
    for m in _DOTTED.finditer(t):
        if m.group().count(".") < 3:
            continue
        parts, at = m.group().split("."), m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            size = sum(map(len, four)) + 3
            if all(len(x.lstrip("0")) <= 3 and int(x[-4:]) <= 255 for x in four):
                out.append((at, at + size))
            at += size + 1
    return out


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def cards(t: str) -> list[tuple[int, int]]:
    out = []
    for m in _CARD.finditer(t):
        if m.end() - m.start() >= 13:
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(m.span())
    return out


def phones(t: str) -> list[tuple[int, int]]:
    if "+" not in t:
        return []
    return [m.span() for m in _PHONE.finditer(t) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]


DETECTORS = {"email": emails, "ip": ips, "card": cards, "phone": phones}


def base_spans(t: str) -> list[tuple[str, int, int]]:
    return [(kind, s, e) for kind, find in DETECTORS.items() for s, e in find(t)]


# Characters that look like an ASCII one, by that one.
LOOKALIKES = {
    "a": "аɑα", "c": "сϲ", "d": "ԁ", "e": "еҽ", "g": "ɡ", "h": "һ", "i": "іıι", "j": "ј", "k": "к", "l": "ӏ", "m": "м", "n": "п", "o": "оοօ", "p": "рρ", "q": "ԛ", "s": "ѕ", "t": "т", "u": "υս", "v": "νѵ", "w": "ԝ", "x": "хχ", "y": "уγ", "z": "ᴢ",
    "A": "АΑ", "B": "ВΒ", "C": "С", "E": "ЕΕ", "H": "НΗ", "I": "ІΙ", "J": "Ј", "K": "КΚ", "M": "МΜ", "N": "Ν", "O": "ОΟ", "P": "РΡ", "S": "Ѕ", "T": "ТΤ", "X": "ХΧ", "Y": "ҮΥ", "Z": "Ζ",
    "@": "﹫", ".": "․。｡·", "-": "‐‑‒–—−", "+": "﹢", " ": "   ",
}
# Characters without width.
INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
# Digits as words.
DIGIT_WORDS = {
    "en": ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine"),
    "de": ("null", "eins", "zwei", "drei", "vier", "fünf", "sechs", "sieben", "acht", "neun"),
    "fr": ("zéro", "un", "deux", "trois", "quatre", "cinq", "six", "sept", "huit", "neuf"),
    "es": ("cero", "uno", "dos", "tres", "cuatro", "cinco", "seis", "siete", "ocho", "nueve"),
}
_VALUE = {w: str(d) for words in DIGIT_WORDS.values() for d, w in enumerate(words)} | {"oh": "0", "dot": ".", "point": ".", "plus": "+"}

_CHARS = {ord(c): k for k, v in LOOKALIKES.items() for c in v} | {ord(c): "" for c in INVISIBLE}
_ODD = re.compile("[" + "".join(map(re.escape, (*map(chr, _CHARS),))) + "！-～٠-٩۰-۹०-९⁰-₉①-⑨\U0001d400-\U0001d7ff]")
_OPEN, _SHUT = r"(?<![ \t])[ \t]*+[\[({<][ \t]*+", r"[ \t]*+[\])}>][ \t]*+"
_DOT_WORD = "(?:dot|punkt|point|punto|DOT|Dot|\\.)"
_AT_WORD = "(?:at|AT|At|arroba|@)"
_BRACKET_AT = re.compile(_OPEN + _AT_WORD + _SHUT)
_BRACKET_DOT = re.compile(_OPEN + _DOT_WORD + _SHUT)
_BRACKET = re.compile(rf"[\[({{<][ \t]*+(?:{_AT_WORD}|{_DOT_WORD})[ \t]*+[\])}}>]")
_LETTER_AT = re.compile(r"(?<=[A-Za-z0-9])[\[(]a[\])](?=[A-Za-z0-9])")
_HOST_DOT = r"(?: (?:dot|DOT|punto|punkt|point|\.) |_dot_|\.)"
_PLAIN = re.compile(rf"(?:(?<![A-Za-z0-9._%+-])|(?<=_at_))(?:(?!_at_)[A-Za-z0-9._%+-])++( at | AT |_at_| arroba | arobase | ?@ ?)[A-Za-z0-9-]+(?:{_HOST_DOT}[A-Za-z0-9-]+)+")
_AT_HOST = re.compile(rf"(?: at | AT |_at_)[A-Za-z0-9-]+{_HOST_DOT}[A-Za-z0-9-]")
# Dots that count only after these ats, as sentences hold them too.
_DOT_NEEDS = {" point ": (" arobase ",), " . ": ("@", " @ ", "@ ", " @")}
_DOTS = re.compile(_HOST_DOT)
_NUMBER = "(?:" + "|".join(sorted({w for v in DIGIT_WORDS.values() for w in v} | {"oh"}, key=lambda w: (-len(w), w))) + ")"
_SPELLED = re.compile(rf"(?<!\w)(?:plus[ ,-]+)?{_NUMBER}(?:(?:[ ]?[,-][ ]?|[ ]+){_NUMBER}){{3,}}(?!\w)|(?<!\w)(?:plus[ ,-]+)?{_NUMBER}(?:(?:[ ]?[,-][ ]?|[ ]+)(?:{_NUMBER}|dot|point)){{4,}}(?!\w)", re.IGNORECASE)
_TOKEN = re.compile(r"\w+")
_ITEM = re.compile(rf"(?<!\w)({_NUMBER}|dot|point|plus)(?!\w)|[0-9]++|\+", re.IGNORECASE)
# What may stand between a number word and its neighbours, and between digits.
_GAP, _DIGIT_GAP = re.compile(r"[\s,()\[\]{}<>/.-]{0,6}"), re.compile(r"[\x20().-]{0,3}")
_MARKS = str.maketrans({c: " " for c in ",()[]{}<>/.-"} | {"+": " + "})
_NUMBERS = frozenset(w for w in _VALUE if w not in (".", "plus"))
# Last labels that a host spelled out without brackets must end in; after a dot spelled as a
# word, any label of two letters or one of the others below will do.
TOP_LEVEL = frozenset("com org net edu gov mil int info biz name io ai app dev co me tv us uk eu de fr es it nl be ch at pl pt ru cn jp in br mx ca au example test".split())
MORE_TOP_LEVEL = frozenset("academy agency app art blog cafe cat center city cloud club design digital email events expert family finance global group guru host house ink jobs live ltd media mobi museum news one online page photos pro rocks shop site social software solutions space store studio support systems team tech tools top travel tv video vip website wiki work world xyz zone".split())


def _plain_char(c: str) -> str:
    """What one odd character stands for."""
    if ord(c) in _CHARS:
        return _CHARS[ord(c)]
    if c.isdecimal():
        return str(unicodedata.decimal(c))
    flat = unicodedata.normalize("NFKC", c)
    return flat if len(flat) == 1 and flat.isascii() else c


class Rewritten:
    """A text with the source span of each of its characters."""

    def __init__(self, text: str):
        self.text, self.start, self.end = text, np.arange(len(text)), np.arange(1, len(text) + 1)
        self.edited = np.zeros(len(text), bool)

    def edit(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace [s, e) by a string, for ordered spans that do not overlap."""
        if not edits:
            return
        text, start, end, edited, at = [], [], [], [], 0
        for s, e, new in edits:
            text += [self.text[at:s], new]
            start += [self.start[at:s], np.full(len(new), self.start[s])]
            end += [self.end[at:s], np.full(len(new), self.end[e - 1])]
            edited += [self.edited[at:s], np.ones(len(new), bool)]
            at = e
        self.text = "".join([*text, self.text[at:]])
        self.start, self.end, self.edited = (np.concatenate([*x, old[at:]]) for x, old in ((start, self.start), (end, self.end), (edited, self.edited)))


def _spelled_edits(t: str) -> list[tuple[int, int, str]]:
    """Each digit word by its digit; what separates two of them goes."""
    out = []
    for m in _SPELLED.finditer(t):
        words = [(w.start(), w.end(), _VALUE[w.group().lower()]) for w in _TOKEN.finditer(t, m.start(), m.end())]
        for k, (s, _, value) in enumerate(words):
            out.append((s, words[k + 1][0] if k + 1 < len(words) else words[k][1], value))
    return out


def _spells_digits(t: str) -> bool:
    """Whether four number words stand in a row."""
    tokens = t.lower().replace(",", " ").replace("-", " ").split()
    return b"\1\1\1\1" in bytes(map(_NUMBERS.__contains__, (w.strip(".;:!?()") for w in tokens))) if not _NUMBERS.isdisjoint(tokens) else False


def _mixes_digits(t: str) -> bool:
    """Whether a number word stands next to another one, to digits or to a plus."""
    tokens = t.lower().translate(_MARKS).split()
    if _NUMBERS.isdisjoint(tokens):
        return False
    kinds = bytes(1 if w in _NUMBERS else 2 if w in ("+", "plus", "dot", "point") or w.isdigit() else 0 for w in tokens)
    return any(x in kinds for x in (b"\1\1", b"\1\2", b"\2\1"))


def _mixed_edits(t: str) -> list[tuple[int, int, str]]:
    """Each number word next to digits, a plus or another number word by its digit; what separates the
    members of such a run goes, but for a dot."""
    runs, last = [], None
    for m in _ITEM.finditer(t):
        gap = _GAP if last and (last.group(1) or m.group(1)) else _DIGIT_GAP
        if last and gap.fullmatch(t, last.end(), m.start()):
            runs[-1].append(m)
        else:
            runs.append([m])
        last = m
    out = []
    for run in runs:
        if len(run) < 2 or not any(m.group(1) for m in run):
            continue
        for k, m in enumerate(run):
            if m.group(1):
                out.append((*m.span(), _VALUE[m.group().lower()]))
            if k + 1 < len(run) and m.end() < run[k + 1].start():
                dot = "." in t[m.end() : run[k + 1].start()] and "." not in (_VALUE.get(m.group().lower()), _VALUE.get(run[k + 1].group().lower()))
                out.append((m.end(), run[k + 1].start(), "." if dot else ""))
    return out


_RUN = re.compile(r"(?<![0-9.+])[0-9]++(?!\.[0-9])")
_COUNTING = "0123456789" * 3


def disguised(t: str) -> bool:
    """Whether any transducer may have work to do; cheap tests first."""
    if (not t.isascii() and _ODD.search(t)) or _BRACKET.search(t) or _AT_HOST.search(t) or "(a)" in t or "[a]" in t:
        return True
    if "@ " in t or " @" in t or " arroba " in t or " arobase " in t or (("dot" in t or "DOT" in t) and _PLAIN.search(t)):
        return True
    return _spells_digits(t) or _mixes_digits(t)


def _host_edits(t: str) -> list[tuple[int, int, str]]:
    """At and dots of addresses spelled out without brackets, up to the last label that is known."""
    out = []
    for m in _PLAIN.finditer(t):
        dots = list(_DOTS.finditer(t, m.end(1), m.end()))
        ends = [*(d.start() for d in dots[1:]), m.end()]
        fine = next((k for k, d in enumerate(dots) if m.group(1) not in _DOT_NEEDS.get(d.group(), (m.group(1),))), len(dots))
        known = max((k for k in range(fine) if _is_last_label(t[dots[k].end() : ends[k]].lower(), dots[k].group())), default=-1)
        edits = [(*m.span(1), "@")] if m.group(1) != "@" else []
        edits += [(*d.span(), ".") for d in dots[: known + 1] if d.group() != "."]
        out += edits if known >= 0 else []
    return out


def _is_last_label(label: str, dot: str) -> bool:
    return label in TOP_LEVEL or (dot.strip(" _").isalpha() and ((len(label) == 2 and label.isalpha()) or label in MORE_TOP_LEVEL))


def _spoken_phones(r: Rewritten) -> list[tuple[str, int, int]]:
    """Runs of 9 to 15 digits that were all words, with or without a plus; counting up is none."""
    if not r.edited.any():
        return []
    runs = ((m.start(), m.end()) for m in _RUN.finditer(r.text) if 9 <= m.end() - m.start() <= 15)
    return [("phone", s, e) for s, e in runs if r.edited[s:e].all() and r.text[s:e] not in _COUNTING]


def rewrite(t: str, mixed: bool = False) -> Rewritten:
    """``t`` without disguises; digits as words in rows of their own, or (``mixed``) next to digits too."""
    r = Rewritten(t)
    if not t.isascii():
        r.edit([(m.start(), m.end(), _plain_char(m.group())) for m in _ODD.finditer(r.text)])
    r.edit([(*m.span(), "@") for m in _BRACKET_AT.finditer(r.text)])
    r.edit([(*m.span(), "@") for m in _LETTER_AT.finditer(r.text)])
    r.edit([(*m.span(), ".") for m in _BRACKET_DOT.finditer(r.text)])
    r.edit(_host_edits(r.text))
    r.edit((_mixed_edits if mixed else _spelled_edits)(r.text))
    return r


def find_spans(t: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, added spans), each by kind and start; code points, end exclusive."""
    base = base_spans(t)
    if not t or not disguised(t):
        return base, []
    # a mixed run may swallow what a strict one holds (a number before a card), so both are searched
    versions = [rewrite(t), *([rewrite(t, True)] if _mixes_digits(t) else [])]
    found = {(s, -e, -1): k for k, s, e in base}
    for r in versions:
        for kind, s, e in [*base_spans(r.text), *_spoken_phones(r)]:
            span = int(r.start[s]), int(r.end[e - 1])
            if r.edited[s:e].any() or span[1] - span[0] != e - s:  # characters without width leave no mark
                found.setdefault((span[0], -span[1], KINDS.index(kind)), kind)
    added, far = [], -1
    for (s, e, mark), kind in sorted(found.items()):  # a span before a later one covers it if it ends no earlier
        if mark >= 0 and -e > far:
            added.append((kind, s, -e))
        far = max(far, -e)
    return base, sorted(added, key=lambda x: (KINDS.index(x[0]), x[1]))


def listing(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1], x[2])))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: base counts by kind, ``base_sha256``, all ``spans``, and ``n_added``."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, digest, spans, more = [], [], [], []
        for t in batch.column(1).to_pylist():
            base, added = find_spans(t or "")
            kinds = [x[0] for x in base]
            counts.append([kinds.count(k) for k in KINDS])
            digest.append(hashlib.sha256(listing(base).encode()).hexdigest())
            spans.append(listing([*base, *added]))
            more.append(len(added))
        by = np.array(counts, np.int64).reshape(-1, len(KINDS))
        cols = [batch.column(0), *(pa.array(by[:, k]) for k in range(len(KINDS))), pa.array(digest, pa.string()), pa.array(spans, pa.string()), pa.array(more, pa.int64())]
        return pa.RecordBatch.from_arrays(cols, names=[id_col, *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, n_added long"
    return arrow_map(docs.select(id_col, text_col), run, schema)


def mask(t: str) -> str:
    """The text with each span replaced by its kind in brackets; of overlapping
    spans, whose union goes, the first one's kind stays."""
    base, added = find_spans(t)
    out, at = [], 0
    for kind, s, e in sorted([*base, *added], key=lambda x: (x[1], -x[2])):
        if e <= at:
            continue
        out += [t[at : max(s, at)], f"[{kind.upper()}]" if s >= at else ""]
        at = e
    return "".join([*out, t[at:]])


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with its texts masked and, if there is such a column, their lengths set anew; a null
    text stays null."""
    at = docs.columns.index(text_col)
    size = docs.columns.index(length_col) if length_col in docs.columns else None

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols = list(batch.columns)
        new = [None if t is None else mask(t) for t in cols[at].to_pylist()]
        cols[at] = pa.array(new, cols[at].type)
        if size is not None:
            cols[size] = pa.array([None if t is None else len(t) for t in new], cols[size].type)
        return pa.RecordBatch.from_arrays(cols, schema=batch.schema)

    return arrow_map(docs, run, docs.schema)
