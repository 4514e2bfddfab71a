"""Front-ends for the brace languages: Java, JavaScript, TypeScript, Go, Rust, C and C++.

One tokenizer and one recursive reader of statements serve all; a table says which words open what.
They emit the same kinds of rows as the Python front-end. Syntax that is not known leads to what is
inside it. Parameters are registered, so their uses carry data flow, in every language."""

from __future__ import annotations

import re
from dataclasses import dataclass
from pathlib import PurePosixPath

from .emitter import Emitter, Scope
from .lexer import PAIR, tokens_of_items


@dataclass(frozen=True)
class Language:
    types: frozenset[str]
    functions: frozenset[str] = frozenset()
    switches: frozenset[str] = frozenset()
    loops: frozenset[str] = frozenset({"for", "while"})
    declare: frozenset[str] = frozenset()
    imports: frozenset[str] = frozenset({"import"})
    this: frozenset[str] = frozenset({"this"})
    null: frozenset[str] = frozenset({"null"})
    typed: bool = False  # a type stands before the name
    field_calls: bool = True


_WORDS = lambda s: frozenset(s.split())
LANGUAGES = {
    "java": Language(_WORDS("class interface enum record"), switches=_WORDS("switch"), loops=_WORDS("for while do"), typed=True),
    "javascript": Language(_WORDS("class"), _WORDS("function"), declare=_WORDS("var let const"), null=_WORDS("null undefined")),
    "typescript": Language(_WORDS("class interface enum"), _WORDS("function"), declare=_WORDS("var let const"), null=_WORDS("null undefined")),
    "tsx": Language(_WORDS("class interface enum"), _WORDS("function"), declare=_WORDS("var let const"), null=_WORDS("null undefined")),
    "go": Language(frozenset(), _WORDS("func"), loops=_WORDS("for"), declare=_WORDS("var const"), null=_WORDS("nil"), this=frozenset()),
    "rust": Language(_WORDS("struct enum trait"), _WORDS("fn"), switches=_WORDS("match"), loops=_WORDS("for while loop"), declare=_WORDS("let const static"), imports=_WORDS("use"), this=_WORDS("self"), null=_WORDS("None")),
    "c": Language(_WORDS("struct"), imports=frozenset(), typed=True, null=_WORDS("NULL")),
    "cpp": Language(_WORDS("class struct"), imports=_WORDS("using"), typed=True, null=_WORDS("NULL nullptr")),
}
_SKIP = _WORDS("public private protected static final abstract synchronized native default async export pub mut unsafe extern inline virtual const constexpr readonly declare override explicit volatile register unsigned signed long short template typename throws await new delete typeof go defer ref dyn move")
_NOT_CALLS = _WORDS("if for while switch catch return sizeof match function func fn else do try new throw case")


class Reader:
    def __init__(self, path: str, text: str, language: str):
        self.t, self.l, self.lang, self.e, self.s = tokens_of_items(text, language), LANGUAGES[language], language, Emitter(path), Scope()
        self.module = self.e.module(PurePosixPath(path).stem)
        self.classes: dict[str, str] = {}
        self.var_types: dict[str, str] = {}

    def run(self) -> Emitter:
        self.block(0, len(self.t), self.module)
        return self.e

    def at(self, i: int) -> tuple[int, int]:
        return self.t[i].line, self.t[i].col

    def is_(self, i: int, *texts: str) -> bool:
        return 0 <= i < len(self.t) and self.t[i].text in texts

    def stop(self, i: int, hi: int, *ends: str) -> int:
        """The first of ``ends`` outside brackets from ``i``, or ``hi``."""
        line_ends = self.lang in ("go", "javascript", "typescript", "tsx") and ";" in ends
        first = i
        while i < hi:
            t = self.t[i]
            if t.text in ends:
                return i
            if line_ends and i > first and t.line > self.t[i - 1].line and self.t[i - 1].text not in _CONTINUES and t.text not in _CONTINUES - _OPENS and t.text not in (")", "]"):
                return i
            i = t.close + 1 if t.close > i else i + 1
        return min(i, hi)

    # -- statements -------------------------------------------------------------------------------

    def block(self, lo: int, hi: int, scope: str) -> None:
        i = lo
        while i < hi:
            i = max(i + 1, self.statement(i, hi, scope))

    def statement(self, i: int, hi: int, scope: str) -> int:
        """Read one statement; where the next begins."""
        t = self.t[i]
        if t.kind == "directive":
            if m := re.match(r'#\s*include\s*[<"]([^>"]+)', t.text):
                self.e.import_(m[1], self.at(i), scope, [m[1]], False)
            return i + 1
        if t.text in (";", ","):
            return i + 1
        if t.text == "{":
            self.s.push()
            self.block(i + 1, t.close, scope)
            self.s.pop()
            return t.close + 1
        if t.text.startswith("@") and t.kind == "name":
            return self.t[i + 1].close + 1 if self.is_(i + 1, "(") else i + 1
        if t.text in self.l.imports or t.text == "package":
            return self.import_(i, hi, scope)
        if t.text == "namespace" or (self.lang == "rust" and t.text == "mod"):
            j = self.stop(i, hi, "{", ";")
            return self.statement(j, hi, scope) if self.is_(j, "{") else j + 1
        if self.lang == "rust" and t.text == "impl":
            return self.impl(i, hi, scope)
        if self.lang == "go" and t.text == "type":
            return self.go_type(i, hi, scope)
        if t.text in self.l.functions and not (self.is_(i + 1, "(") and self.lang not in ("go",)):
            return self.function(i, hi, scope)
        if t.text in self.l.types and i + 1 < hi and self.t[i + 1].kind == "name" and (j := self.stop(i, hi, "{", ";", "=")) < hi and not self.is_(j, "="):
            if self.lang == "c" and not self.is_(j, "{"):
                return self.plain(i, hi, scope)
            return self.type_(i, j, scope) if self.is_(j, "{", ";") and not any(self.is_(k, "(") for k in range(i, j) if self.lang in ("c", "cpp")) else self.plain(i, hi, scope)
        if t.text == "if":
            return self.if_(i, hi, scope)
        if t.text in self.l.loops:
            return self.loop(i, hi, scope)
        if t.text in self.l.switches:
            b = self.e.branch(self.at(i), scope, t.text)
            j = self.stop(i + 1, hi, "{")
            self.values(i + 1, j, b)
            if self.is_(j, "{"):
                self.block(j + 1, self.t[j].close, b)
                return self.t[j].close + 1
            return j
        if t.text == "return":
            j = self.stop(i + 1, hi, ";", "}")
            r = self.e.return_(self.at(i), scope)
            for v in self.values(i + 1, j, scope):
                self.e.data_flow(v, r)
            return j
        if t.text == "catch" and self.is_(i + 1, "("):
            names = [k for k in range(i + 2, self.t[i + 1].close) if self.t[k].kind == "name"]
            if names:
                self.s.define(self.t[names[-1]].text, self.e.variable(self.t[names[-1]].text, self.at(names[-1]), scope))
            return self.t[i + 1].close + 1
        if t.text in _SKIP or t.text in ("try", "else", "finally", "do"):
            return i + 1
        return self.plain(i, hi, scope)

    def import_(self, i: int, hi: int, scope: str) -> int:
        if self.lang == "go" and self.is_(i + 1, "("):
            for k in range(i + 2, self.t[i + 1].close):
                if self.t[k].kind == "str":
                    self._import(k, self.t[k].text[1:-1], scope)
            return self.t[i + 1].close + 1
        j = self.stop(i + 1, hi, ";")
        words = [k for k in range(i + 1, j)]
        if self.t[i].text != "package":
            quoted = [self.t[k].text[1:-1] for k in words if self.t[k].kind == "str"]
            name = quoted[-1] if quoted else "".join(self.t[k].text for k in words if self.t[k].text not in ("static", "namespace"))
            if self.is_(i + 1, "("):
                return self.plain(i, hi, scope)
            names = [self.t[k].text for k in words if self.t[k].kind == "name" and self.t[k].text not in ("from", "as", "type", "static", "namespace")]
            self._import(i, name, scope, names if quoted and names else None)
        return j

    def _import(self, i: int, module: str, scope: str, names: list[str] | None = None) -> None:
        last = re.split(r"\.|::|/", module)[-1].strip("{}*")
        node = self.e.import_(module, self.at(i), scope, names or [last or module], bool(names))
        for n in names or [last]:
            self.s.define(n, node)

    def type_(self, i: int, j: int, scope: str) -> int:
        name = self.t[i + 1].text
        bases = [self.t[k].text for k in range(i + 2, j) if self.t[k].kind == "name" and self.t[k].text not in ("extends", "implements", "public", "private", "protected", "virtual")] if not self.is_(i + 2, "(", "<") else []
        close = self.t[j].close if self.is_(j, "{") else j
        c = self.e.class_(name, self.at(i), scope, self.at(close) if close < len(self.t) else None, bases)
        self.s.define(name, c)
        self.classes[name] = c
        if self.is_(i + 2, "(") and self.lang == "java":
            self.parameters(i + 2, c)
        if self.is_(j, "{") and self.t[i].text not in ("enum", "interface") and not (self.lang in ("c", "rust") and self.t[i].text != "trait"):
            self.s.push()
            self.members(j + 1, close, c, name)
            self.s.pop()
        return close + 1

    def members(self, lo: int, hi: int, scope: str, owner: str) -> None:
        i = lo
        while i < hi:
            j = self.stop(i, hi, ";", "{", "=")
            call = next((k for k in range(i, j) if self.is_(k, "(")), None)
            if call is not None and self.is_(j, "{") and self.t[call - 1].kind == "name" and self.t[i].text not in self.l.types:
                i = self.body(call - 1, call, j, scope)
            elif self.is_(j, "{") or self.t[i].text in self.l.functions:
                i = max(i + 1, self.statement(i, hi, scope))
            elif self.is_(j, "="):
                k = self.stop(j, hi, ";")
                self.assign(i, j, k, scope)
                i = k + 1
            else:
                i = j + 1

    def go_type(self, i: int, hi: int, scope: str) -> int:
        j = self.stop(i, hi, "{", ";")
        if self.is_(i + 2, "struct") and self.is_(j, "{"):
            name = self.t[i + 1].text
            self.classes[name] = self.e.class_(name, self.at(i), scope, self.at(self.t[j].close))
            self.s.define(name, self.classes[name])
        return (self.t[j].close if self.is_(j, "{") else j) + 1

    def impl(self, i: int, hi: int, scope: str) -> int:
        j = self.stop(i, hi, "{")
        names = [self.t[k].text for k in range(i + 1, j) if self.t[k].kind == "name" and self.t[k].text != "for"]
        self.block(j + 1, self.t[j].close, self.classes.get(names[-1] if names else "", scope))
        return self.t[j].close + 1

    def function(self, i: int, hi: int, scope: str) -> int:
        k = i + 1
        if self.lang == "go" and self.is_(k, "("):
            k = self.t[k].close + 1
        while k < hi and self.is_(k, "*"):
            k += 1
        call = self.stop(k, hi, "(")
        if call >= hi or self.t[k].kind != "name":
            return i + 1
        j = self.stop(self.t[call].close + 1, hi, "{", ";")
        return self.body(k, call, j, scope, receiver=i + 1 if self.lang == "go" and self.is_(i + 1, "(") else None)

    def body(self, name: int, call: int, brace: int, scope: str, receiver: int | None = None, called: str | None = None) -> int:
        close = self.t[brace].close if self.is_(brace, "{") else brace
        f = self.e.function(called or self.t[name].text, self.at(name), scope, self.at(min(close, len(self.t) - 1)), any(self.is_(k, "async") for k in range(max(0, name - 2), name)))
        self.s.define(called or self.t[name].text, f)
        self.s.push()
        if receiver is not None:
            self.parameters(receiver, f)
        self.parameters(call, f)
        if self.is_(brace, "{"):
            self.block(brace + 1, close, f)
        self.s.pop()
        return close + 1

    def parameters(self, paren: int, f: str) -> None:
        i, position = paren + 1, 0
        close = self.t[paren].close
        while i < close:
            j = self.stop(i, close, ",")
            names = [k for k in range(i, j) if self.t[k].kind == "name" and self.t[k].text not in ("mut", "final", "const", "ref")]
            cut = next((k for k in range(i, j) if self.is_(k, ":", "=")), j)
            before = [k for k in names if k < cut]
            if before and self.t[before[0]].text not in self.l.this | {"void"}:
                last = self.l.typed
                n = before[-1] if last else before[0]
                kind = "".join(self.t[k].text for k in (range(i, n) if last else range(n + 1, j)) if self.t[k].text not in (":", "final", "const")) or None
                p = self.e.parameter(self.t[n].text, self.at(n), f, position, kind)
                self.s.define(self.t[n].text, p)
                if kind:
                    self.var_types[self.t[n].text] = re.split(r"[<\[*&.]", kind)[0]
                position += 1
            i = j + 1

    def if_(self, i: int, hi: int, scope: str) -> int:
        b = self.e.branch(self.at(i), scope, "if", False)
        at = len(self.e.nodes) - 1
        j = self.header(i + 1, hi, b)
        j = self.part(j, hi, b)
        if self.is_(j, "else"):
            node = self.e.nodes[at]
            self.e.nodes[at] = (*node[:9], (node[9] or "").replace('"has_else": false', '"has_else": true'), node[10])
            j = self.part(j + 1, hi, b)
        return j

    def header(self, i: int, hi: int, scope: str) -> int:
        """The condition: in parentheses, or up to the brace."""
        if self.is_(i, "(") and self.lang not in ("go", "rust"):
            self.clauses(i + 1, self.t[i].close, scope)
            return self.t[i].close + 1
        j = i
        while j < hi and not self.is_(j, "{"):
            j = self.t[j].close + 1 if self.t[j].close > j else j + 1
        self.clauses(i, j, scope)
        return j

    def clauses(self, lo: int, hi: int, scope: str) -> None:
        while lo < hi:
            j = self.stop(lo, hi, ";", ",")
            self.plain(lo, j, scope)
            lo = j + 1

    def part(self, i: int, hi: int, scope: str) -> int:
        if self.is_(i, "{"):
            self.block(i + 1, self.t[i].close, scope)
            return self.t[i].close + 1
        return self.statement(i, hi, scope) if i < hi else i

    def loop(self, i: int, hi: int, scope: str) -> int:
        word = self.t[i].text
        lp = self.e.loop(self.at(i), scope, "do_while" if word == "do" else word)
        if word in ("do", "loop"):
            j = self.part(i + 1, hi, lp)
            if word == "do" and self.is_(j, "while") and self.is_(j + 1, "("):
                self.values(j + 2, self.t[j + 1].close, lp)
                j = self.t[j + 1].close + 1
            return j
        lo, end = (i + 2, self.t[i + 1].close) if self.is_(i + 1, "(") and self.lang not in ("go", "rust") else (i + 1, self.stop_brace(i + 1, hi))
        each = next((k for k in range(lo, end) if self.is_(k, "in", "of", ":", "range")), None)
        if word == "for" and each is not None and not any(self.is_(k, ";", "?") for k in range(lo, end)):
            source = self.values(each + 1, end, lp)
            for k in range(lo, each):
                if self.t[k].kind == "name" and self.t[k].text not in self.l.declare | _SKIP and (not self.l.typed or k == each - 1):
                    v = self.e.variable(self.t[k].text, self.at(k), lp)
                    for x in source[:1]:
                        self.e.definition(v, x)
                        self.e.data_flow(x, v)
                    self.s.define(self.t[k].text, v)
        else:
            self.clauses(lo, end, lp)
        return self.part(end + 1 if self.is_(end, ")") else end, hi, lp)

    def stop_brace(self, i: int, hi: int) -> int:
        while i < hi and not self.is_(i, "{"):
            i = self.t[i].close + 1 if self.t[i].close > i else i + 1
        return i

    # -- expressions ------------------------------------------------------------------------------

    def plain(self, i: int, hi: int, scope: str) -> int:
        """A declaration, an assignment or an expression."""
        end = self.stop(i, hi, ";")
        eq = next((k for k in self.top(i, end) if self.is_(k, "=", ":=", "+=", "-=", "*=", "/=", "|=", "&=")), None)
        brace = next((k for k in self.top(i, end) if self.is_(k, "{")), None)
        call = next((k for k in self.top(i, end) if self.is_(k, "(")), None)
        if self.l.typed and call is not None and brace is not None and call < brace and (eq is None or brace < eq) and self.t[call - 1].kind == "name" and self.t[call - 1].text not in _NOT_CALLS and (call - 1 > i or self.lang == "java"):
            return self.body(call - 1, call, brace, scope)
        if eq is not None:
            self.assign(i, eq, end, scope)
        elif self.t[i].text in self.l.declare or (self.l.typed and end - i == 2 and all(self.t[k].kind == "name" for k in (i, i + 1))):
            names = [k for k in range(i + 1, end) if self.t[k].kind == "name" and self.t[k].text not in _SKIP]
            if names:
                n = names[-1] if self.l.typed else names[0]
                self.s.define(self.t[n].text, self.e.variable(self.t[n].text, self.at(n), scope, self.t[i].text if self.l.typed else None))
        elif self.lang == "cpp" and call is not None and call - i == 2 and all(self.t[k].kind == "name" for k in (i, i + 1)):
            self.construct(i, call, scope)
        else:
            self.values(i, end, scope)
        return end

    def construct(self, i: int, call: int, scope: str) -> None:
        """``Type name(args)``: a call of the type that defines the name."""
        c = self.invoke(self.t[i].text, i, call, scope, None)
        v = self.e.variable(self.t[i + 1].text, self.at(i + 1), scope, self.t[i].text)
        self.e.definition(v, c)
        self.e.data_flow(c, v)
        self.s.define(self.t[i + 1].text, v)

    def top(self, lo: int, hi: int):
        while lo < hi:
            yield lo
            lo = self.t[lo].close + 1 if self.t[lo].close > lo else lo + 1

    def assign(self, lo: int, eq: int, end: int, scope: str) -> None:
        cut = next((k for k in range(lo, eq) if self.is_(k, ":")), eq) if self.lang in ("typescript", "tsx", "rust") else eq
        arrow = next((k for k in self.top(eq, end) if self.is_(k, "=>")), None)
        value = eq + 1
        while self.is_(value, "async", "await"):
            value += 1
        target = [k for k in range(lo, cut) if self.t[k].kind == "name" and self.t[k].text not in self.l.declare | _SKIP]
        if not target:
            self.values(eq + 1, end, scope)
            return
        if self.lang in ("javascript", "typescript", "tsx") and (arrow is not None or self.is_(value, "function")):
            name = target[-1]
            call = next((k for k in range(value, end) if self.is_(k, "(")), None)
            if arrow is not None and not self.is_(value, "("):
                call = None
            if call is not None:
                brace = self.stop_brace(self.t[call].close + 1, end)
                if arrow is not None and not self.is_(arrow + 1, "{"):
                    self.arrow(name, call, arrow, end, scope)
                else:
                    self.body(name, call, brace, scope)
                return
        parts, k = [], eq + 1
        while k < end:
            j = self.stop(k, end, ",")
            parts.append(self.values(k, j, scope))
            k = j + 1
        several = self.lang == "go" and any(self.is_(k, ",") for k in self.top(lo, eq))
        if several:
            names = [k for k in target if k == lo or self.is_(k - 1, ",", "var", "const")]
        else:
            names = [self.name_of(lo, cut, target)]
        inferred = self.t[target[0]].text if self.l.typed and len(target) > 1 and not self.is_(target[0] + 1, ".", "->") else None
        for n, name in enumerate(names):
            text = self.t[name].text
            if text == "_":
                continue
            got = parts[n] if several and len(parts) == len(names) else parts[0] if parts else []
            old = self.s.lookup(text)
            if self.lang == "go" and self.is_(eq, "=") and old:
                v = old
            else:
                v = self.e.variable(self.dotted(lo, cut) if not several and self.is_(name - 1, ".", "->") else text, self.at(name), scope, inferred)
            for x in got[:1]:
                if not (self.lang == "c" and self.t[lo].kind == "name" and lo + 1 == eq):
                    self.e.definition(v, x)
                self.e.data_flow(x, v)
            self.s.define(text, v)
            if inferred:
                self.var_types[text] = inferred

    def name_of(self, lo: int, hi: int, names: list[int]) -> int:
        index = next((k for k in range(lo, hi) if self.is_(k, "[")), None)
        before = [k for k in names if index is None or k < index]
        return (before or names)[-1]

    def dotted(self, lo: int, hi: int) -> str:
        return "".join(self.t[k].text for k in range(lo, hi) if self.t[k].text not in self.l.declare)

    def arrow(self, name: int, call: int, arrow: int, end: int, scope: str) -> None:
        """``name = (a, b) => value``."""
        f = self.e.function(self.t[name].text, self.at(name), scope)
        self.s.define(self.t[name].text, f)
        self.s.push()
        self.parameters(call, f)
        r = self.e.return_(self.at(arrow), f)
        for v in self.values(arrow + 1, end, f)[:1]:
            self.e.data_flow(v, r)
        self.s.pop()

    def values(self, lo: int, hi: int, scope: str) -> list[str]:
        """Nodes that an expression's data comes from, the left one first; a string concatenation with
        ``+`` in Java is a call of its own fed by its parts."""
        if self.lang == "java" and (q := self.ternary(lo, hi)):
            return self.choice(lo, *q, hi, scope)
        found, i, plus, text = [], lo, False, False
        while i < hi:
            t = self.t[i]
            if t.kind == "str" or t.kind == "num" or t.text in self.l.null or t.text in ("true", "false"):
                kind = "str" if t.kind == "str" else "number" if t.kind == "num" else "bool" if t.text in ("true", "false") else "null"
                found.append(self.e.literal(t.text, self.at(i), scope, kind))
                text = text or t.kind == "str"
                i += 1
            elif t.kind == "name" and t.text in self.l.functions and (call := self.stop(i, hi, "(")) < hi:
                brace = self.stop_brace(self.t[call].close + 1, hi)
                i = self.body(i, call, brace, scope, called=f"{t.text}${t.line}${t.col}")
            elif t.kind == "name" and t.text not in _SKIP:
                node, i = self.chain(i, hi, scope)
                if node:
                    found.append(node)
            elif t.text == "(" and self.is_(t.close + 1, "=>", "->"):
                i = self.lambda_(i, hi, scope)
            elif t.text in PAIR:
                if t.text == "{":
                    self.block(i + 1, t.close, scope)
                else:
                    found += self.values(i + 1, t.close, scope)[:1]
                i = t.close + 1
            else:
                plus = plus or t.text == "+"
                i += 1
        if self.lang == "java" and plus and text and len(found) > 1:
            c = self.e.call("<string_concat>", self.at(lo), scope, len(found))
            for x in found:
                self.e.data_flow(x, c)
            return [c]
        return found

    def ternary(self, lo: int, hi: int) -> tuple[int, int] | None:
        """Where the ``?`` of the outermost choice stands and its ``:``; a wildcard of a type is none."""
        first, depth = None, 0
        for k in self.top(lo, hi):
            if self.is_(k, "->"):
                return None
            if self.is_(k, "?") and not self.is_(k - 1, "<", ",") and not self.is_(k + 1, ">", "extends", "super"):
                first, depth = k if first is None else first, depth + 1
            elif self.is_(k, ":") and first is not None:
                depth -= 1
                if not depth:
                    return first, k
        return None

    def choice(self, lo: int, ask: int, colon: int, hi: int, scope: str) -> list[str]:
        """``condition ? a : b``: a call of its own fed by both values."""
        self.values(lo, ask, scope)
        both = [self.values(ask + 1, colon, scope)[:1], self.values(colon + 1, hi, scope)[:1]]
        c = self.e.call("<ternary>", self.at(lo), scope, 2)
        for x in both[0] + both[1]:
            self.e.data_flow(x, c)
        return [c]

    def lambda_(self, i: int, hi: int, scope: str) -> int:
        arrow = self.t[i].close + 1
        line, col = self.at(i)
        f = self.e.function(f"lambda${line}${col}", (line, col), scope)
        self.s.push()
        self.parameters(i, f)
        if self.is_(arrow + 1, "{"):
            self.block(arrow + 2, self.t[arrow + 1].close, f)
            end = self.t[arrow + 1].close + 1
        else:
            end = self.stop(arrow + 1, hi, ",", ";")
            self.values(arrow + 1, end, f)
        self.s.pop()
        return end

    def chain(self, i: int, hi: int, scope: str) -> tuple[str | None, int]:
        """Names, members, calls and indexes in a row; the node of its last part, and where it ends."""
        name, node = self.t[i].text, self.s.lookup(self.t[i].text)
        start, owner = i, self.var_types.get(name)
        i += 1
        while i < hi:
            if self.is_(i, "(") and name.split(".")[-1] not in _NOT_CALLS:
                receiver = node if start is not None and i - start > 1 and node and not node.startswith(("import:", "function:", "class:")) else None
                node = self.invoke(name, start, i, scope, receiver, owner if i - start > 1 else None)
                i = self.t[i].close + 1
            elif self.lang == "java" and self.is_(i, "::") and i + 1 < hi and self.t[i + 1].kind == "name":
                node = self.e.call(f"{name}.{self.t[i + 1].text}", self.at(start), scope, 0)  # a method reference
                i += 2
            elif self.is_(i, ".", "->", "::") and i + 1 < hi and self.t[i + 1].kind == "name":
                sep = "::" if self.is_(i, "::") else "."
                name, i = name + sep + self.t[i + 1].text, i + 2
                if not self.is_(i, "(", ".", "->", "::") and node and self.lang not in ("javascript", "typescript", "tsx"):
                    v = self.e.variable(name, self.at(i - 1), scope)
                    self.e.data_flow(node, v, None if self.lang == "java" else self.t[i - 1].text)
                    node = v
                elif not self.is_(i, "(", ".", "->", "::"):
                    node = None
            elif self.is_(i, "["):
                self.values(i + 1, self.t[i].close, scope)
                i = self.t[i].close + 1
            elif self.is_(i, "<") and self.lang in ("java", "cpp", "typescript", "rust") and (g := self.generic(i, hi)):
                i = g
            else:
                break
        return node, i

    def generic(self, i: int, hi: int) -> int | None:
        """The end of ``<...>`` if it is a list of types before a call."""
        k = i + 1
        while k < hi and (self.t[k].kind == "name" or self.is_(k, ",", ".", "::", "?", "&", "*")):
            k += 1
        return k + 1 if self.is_(k, ">") and self.is_(k + 1, "(") else None

    def invoke(self, name: str, at: int, paren: int, scope: str, receiver: str | None, owner: str | None = None) -> str:
        args, k, close = [], paren + 1, self.t[paren].close
        while k < close:
            j = self.stop(k, close, ",")
            args.append((self.values(k, j, scope), j - k == 1 and self.t[k].kind == "name"))
            k = j + 1
        c = self.e.call(name, self.at(at), scope, len(args), owner)
        if receiver:
            self.e.data_flow(receiver, c)
        for got, bare in args:
            for v in got[:1]:
                self.e.data_flow(v, c)
                if bare and self.lang != "go":
                    self.e.usage(v, c)
        return c


_CONTINUES = _WORDS("+ - * / % = == != < > <= >= && || | & ^ ? : , . -> => := ( [ { += -= *= /= ! in of instanceof return")

_OPENS = _WORDS("return ! ( [")


def parse(path: str, content: bytes, language: str) -> Emitter:
    try:
        return Reader(path, content.decode("utf-8", "replace"), language).run()
    except RecursionError:
        raise SyntaxError("nested too deeply") from None
