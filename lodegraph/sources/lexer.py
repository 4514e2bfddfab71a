"""Tokens of the brace languages, with the place of each bracket's partner.

What a character means may depend on the token before it (a slash after a value divides, elsewhere it
opens a regular expression) and may nest (templates, elements of JSX), so this is a scanner with one
pattern a language and three hooks, not one pattern for all."""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass

PAIR = {"(": ")", "[": "]", "{": "}"}
_OPS = r"""(?P<op>::|->|=>|:=|==|!=|<=|>=|&&|\|\||\+\+|--|[-+*/%&|^]=|\.\.\.|.)"""
_NAME = r"""(?P<name>[A-Za-z_$@][\w$]*(?:!(?=[\(\[{]))?)"""
_COMMENT = r"""(?P<ws>\s+)|(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))"""
_DIRECTIVE = r"""(?P<directive>^[ \t]*\#(?:\\\r?\n|[^\n])*)"""
_QUOTED = r""""(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])+'"""
_NUM = r"""(?P<num>\d[\w.]*)"""


def _pattern(*strings: str, num: str = _NUM, before: str = "") -> re.Pattern:
    return re.compile("|".join([_COMMENT, *([before] if before else []), _DIRECTIVE, f"(?P<str>{'|'.join(strings)})", num, _NAME, _OPS]), re.S | re.M)


_C = _pattern(r'(?:u8|[uUL])?R"(?P<fence>[^\s()\\]{0,16})\(.*?\)(?P=fence)"', r"(?:u8|[uUL])?" + f"(?:{_QUOTED})", num=r"(?P<num>\d[\w.]*(?:'\w+)*)")
PATTERNS = {
    "java": _pattern(r'"""(?:\\.|[^\\])*?"""', _QUOTED),
    "javascript": _pattern(_QUOTED, r"''"),
    "go": _pattern(r"`[^`]*`", _QUOTED),
    # a lifetime or a label is no token of its own
    "rust": _pattern(r'b?r(?P<hashes>\#*)".*?"(?P=hashes)', r'b?"(?:\\.|[^"\\])*"', r"b?'(?:\\(?:u\{[^}]*\}|x..|.)|[^'\\\n])'", before=r"(?P<life>'[A-Za-z_]\w*\b(?!'):?)"),
    "c": _C,
    "cpp": _C,
}
PATTERNS |= dict.fromkeys(("typescript", "tsx"), PATTERNS["javascript"])
_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[A-Za-z]*")
_BEFORE_VALUE = frozenset("return typeof case in of delete void throw new instanceof do else yield await default".split())
_ELEMENT = re.compile(r"<(?=[A-Za-z_$>])(?![A-Z]\w*\s*(?:,|extends\b|=))")
_TAG_NAME = re.compile(r"\s*[\w$.:-]*")
_IN_TAG = re.compile(r"\s+|//[^\n]*|/\*.*?\*/|[\w$:-]+|=|\"[^\"]*\"|'[^']*'", re.S)
_TAG_TEXT = re.compile(r"[^<{]+")


@dataclass
class Tok:
    kind: str
    text: str
    line: int
    col: int
    close: int = -1


class _Lexer:
    def __init__(self, text: str, language: str):
        self.text, self.out, self.stack = text, [], []
        self.pattern = PATTERNS[language]
        self.script, self.elements = language in ("javascript", "typescript", "tsx"), language in ("javascript", "tsx")
        self.lines = [0, *(m.end() for m in re.finditer("\n", text))]

    def add(self, kind: str, s: str, pos: int) -> None:
        line = bisect_right(self.lines, pos)
        t = Tok(kind, s, line, len(self.text[self.lines[line - 1] : pos].encode("utf-8", "surrogatepass")))
        if kind == "op" and s in PAIR:
            self.stack.append(len(self.out))
        elif kind == "op" and s in (")", "]", "}"):
            if not self.stack or PAIR[self.out[self.stack[-1]].text] != s:
                raise SyntaxError(f"line {line}: {s!r} without its partner")
            self.out[self.stack.pop()].close = len(self.out)
        self.out.append(t)

    def value_next(self) -> bool:
        """Whether a value, not an operator, is due."""
        if not self.out:
            return True
        t = self.out[-1]
        return t.text in _BEFORE_VALUE if t.kind == "name" else t.kind == "op" and t.text not in (")", "]", "}", "++", "--")

    def code(self, pos: int, inside: bool = False) -> int:
        """Read code from ``pos``; with ``inside`` up to the brace that closes it. Where it ends."""
        depth, text = len(self.stack), self.text
        while pos < len(text):
            c = text[pos]
            if inside and c == "}" and len(self.stack) == depth:
                return pos + 1
            if self.script and c == "`":
                end = self.template(pos)
                self.add("str", text[pos:end], pos)
                pos = end
                continue
            if self.script and c == "/" and self.value_next() and (m := _REGEX.match(text, pos)):
                self.add("str", m.group(), pos)
                pos = m.end()
                continue
            if self.elements and c == "<" and self.value_next() and _ELEMENT.match(text, pos):
                pos = self.element(pos)
                continue
            m = self.pattern.match(text, pos)
            kind, s = m.lastgroup, m.group()
            if kind in ("fence", "hashes"):
                kind = "str"
            if kind not in ("ws", "comment", "life"):
                self.add(kind, s.strip() if kind == "directive" else s, pos)
            pos = m.end()
        if inside:
            raise SyntaxError("an expression in an element is not closed")
        return pos

    def template(self, pos: int) -> int:
        """The end of the template that opens at ``pos``; templates may stand in its expressions."""
        held, text = ["`"], self.text  # what is open: templates and braces
        pos += 1
        while held:
            if pos >= len(text):
                raise SyntaxError("a template is not closed")
            c = text[pos]
            if held[-1] == "`":
                if c == "\\":
                    pos += 1
                elif c == "`":
                    held.pop()
                elif c == "$" and text[pos + 1 : pos + 2] == "{":
                    held.append("{")
                    pos += 1
            elif c == "`" or c == "{":
                held.append(c)
            elif c == "}":
                held.pop()
            elif c in "\"'" and (m := self.pattern.match(text, pos)):
                pos = m.end() - 1
            pos += 1
        return pos

    def element(self, pos: int) -> int:
        """Read an element of JSX: a pair of parentheses around the expressions in it. Where it ends."""
        text = self.text
        self.add("op", "(", pos)
        pos = _TAG_NAME.match(text, pos + 1).end()
        while True:
            if text.startswith("/>", pos):
                self.add("op", ")", pos)
                return pos + 2
            if pos >= len(text):
                raise SyntaxError("an element is not closed")
            if text[pos] == ">":
                break
            if text[pos] == "{":
                pos = self.container(pos)
            elif m := _IN_TAG.match(text, pos):
                pos = m.end()
            else:
                raise SyntaxError(f"{text[pos]!r} in a tag")
        pos += 1
        while pos < len(text):
            if m := _TAG_TEXT.match(text, pos):
                pos = m.end()
            elif text[pos] == "{":
                pos = self.container(pos)
            elif text.startswith("</", pos):
                end = text.find(">", pos)
                if end < 0:
                    break
                self.add("op", ")", end)
                return end + 1
            else:
                pos = self.element(pos)
                self.add("op", ",", pos - 1)
        raise SyntaxError("an element is not closed")

    def container(self, pos: int) -> int:
        end = self.code(pos + 1, True)
        self.add("op", ",", end - 1)
        return end


def tokens(text: str, language: str = "java") -> list[Tok]:
    """All tokens; a bracket without its partner is an error."""
    lexer = _Lexer(text, language)
    lexer.code(0)
    if lexer.stack:
        t = lexer.out[lexer.stack[-1]]
        raise SyntaxError(f"line {t.line}: {t.text!r} is not closed")
    return lexer.out


#: Pieces of a broken file that are joined in search of a balanced item.
MOST_JOINED = 200
_ITEM = re.compile(r"^(?=[^\s)}\]{#*/])", re.M)


def tokens_of_items(text: str, language: str = "java") -> list[Tok]:
    """As ``tokens``; of a text that does not balance, those of the top-level items that do, an item
    beginning on a line that is not indented. An error if none does."""
    try:
        return tokens(text, language)
    except SyntaxError as e:
        error = e
    cuts = [*sorted({0, *(m.start() for m in _ITEM.finditer(text))}), len(text)]
    out: list[Tok] = []
    k = 0
    while k < len(cuts) - 1:
        for end in range(k + 1, min(len(cuts), k + MOST_JOINED)):
            try:
                some = tokens(text[cuts[k] : cuts[end]], language)
            except SyntaxError:
                continue
            lines = text.count("\n", 0, cuts[k])
            for t in some:
                t.line, t.close = t.line + lines, t.close + len(out) if t.close >= 0 else -1
            out += some
            k = end - 1
            break
        k += 1
    if not out:
        raise error
    return out
