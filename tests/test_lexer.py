"""Everyday code that a naive tokenizer loses: each sample must give its functions and its flows."""

import pytest

from lodegraph.sources import brace_code
from lodegraph.sources.lexer import tokens

SAMPLES = [
    ("rust", "struct S<'a> { x: &'a str }\nimpl<'a> S<'a> { fn get(&self, q: &'a str) -> &'a str { let z = f(q); z } }\nfn longest<'a>(x: &'a str, y: &'a str) -> &'a str { let r = g(x); r }\nfn last() { 'outer: loop { let c = '('; h(c); break 'outer; } }", {"get", "longest", "last"}, {("q", "f"), ("x", "g"), ("c", "h")}),
    ("rust", 'fn a() { let s = r#"un{balanced " (("#; let t = br"\\"; f(s); }\nfn b(p: u8) { let m = "two\nlines ("; g(p); }', {"a", "b"}, {("s", "f"), ("p", "g")}),
    ("javascript", "function a(x) { const r = /[(]/; return f(x); }\nfunction b(y) { const q = y / 2 / g(y); return q; }\nconst c = (z) => z.replace(/\\//g, '(') + h(z);", {"a", "b", "c"}, {("x", "f"), ("y", "g"), ("z", "h")}),
    ("javascript", "function a(x) { const t = `one ${`two ${x} (`} { ${f({k: '}'})}`; return f(x); }\nfunction b(y) { return g(y); }", {"a", "b"}, {("x", "f"), ("y", "g")}),
    ("typescript", "function a<T>(x: T): T { const re = /\\)/; return f(x); }\nclass K { run(y: string) { return g(y); } }", {"a", "run"}, {("x", "f"), ("y", "g")}),
    ("tsx", "function A(x: string) { return <p title=\"it's (\" id={f(x)}>Don't (do {g(x)} <b/> it's</p>; }\nfunction B(y: string) { const e = <>{y ? <i>(</i> : h(y)}</>; return e; }", {"A", "B"}, {("x", "f"), ("x", "g"), ("y", "h")}),
    ("java", 'class A { void a(String x) { String s = """\n  un"balanced ( { \\"""\n  """; f(x); }\n void b(String y) { g(y); } }', {"a", "b"}, {("x", "f"), ("y", "g")}),
    ("java", "class A { void t(boolean flag, String a, String b, java.util.List<?> l) { String result = flag ? a : b; String other = flag ? f(a) : flag ? b : \"x\"; } }", {"t"}, {("a", "<ternary>"), ("b", "<ternary>"), ("<ternary>", "result"), ("f", "<ternary>"), ("<ternary>", "<ternary>"), ("<ternary>", "other")}),
    ("java", "class A { void t(java.util.List<String> items, String[] args, Object o) { String first = args[0]; boolean b = o instanceof String; items.stream().map(String::toUpperCase); } }", {"t"}, {("args", "first"), ("o", "b")}),
    ("cpp", 'int a(int x) { auto s = R"(un"balanced ( {)"; auto t = u8R"--(a)" )--"; return f(x); }\nint b(int y) { int big = 1\'000\'000; char c = \'(\'; return g(y); }', {"a", "b"}, {("x", "f"), ("y", "g")}),
    ("c", "#define LOOP(x) \\\n  do { f(x; \\\n  while (0\nint a(int x) { return f(x); }\n", {"a"}, {("x", "f")}),
    ("go", 'package p\nfunc a(x string) string {\n\ts := `raw \\` + "("\n\treturn f(x)\n}\n', {"a"}, {("x", "f")}),
]


@pytest.mark.parametrize("language, code, functions, flows", SAMPLES, ids=lambda x: x[:12] if isinstance(x, str) else "")
def test_samples_keep_their_functions_and_flows(language, code, functions, flows):
    e = brace_code.parse("x", code.encode(), language)
    name = {n[0]: n[2] for n in e.nodes}
    assert functions <= {n[2] for n in e.nodes if n[1] == "function"}
    assert flows <= {(name[s], name[t]) for s, t, k, *_ in e.edges if k == "data_flows_to"}


def test_method_references_are_calls():
    e = brace_code.parse("x", b"class A { void t(java.util.List<String> l) { l.forEach(System.out::println); l.stream().map(String::toUpperCase); } }", "java")
    assert {"System.out.println", "String.toUpperCase"} <= {n[2] for n in e.nodes if n[1] == "call"}


@pytest.mark.parametrize("language", ["c", "rust", "go", "javascript"])
def test_a_broken_item_does_not_take_the_file(language):
    word = {"c": "int", "rust": "fn", "go": "func", "javascript": "function"}[language]
    code = f"{word} one(int_x) {{ return f(1); }}\n{word} two(int_y) {{ return g((2; }}\n{word} three(int_z) {{\n  return h(3);\n}}\n"
    e = brace_code.parse("x", code.encode(), language)
    assert {"one", "three"} <= {n[2] for n in e.nodes if n[1] == "function"} and "two" not in {n[2] for n in e.nodes}
    assert next(n for n in e.nodes if n[2] == "three")[4] == 3
    with pytest.raises(SyntaxError):
        brace_code.parse("x", b"f(", language)


def test_places_and_partners():
    t = tokens("é(\n a[1])", "java")
    assert [(x.text, x.line, x.col) for x in t] == [("é", 1, 0), ("(", 1, 2), ("a", 2, 1), ("[", 2, 2), ("1", 2, 3), ("]", 2, 4), (")", 2, 5)]
    assert t[1].close == 6 and t[3].close == 5
    for hard in ("(" * 20_000 + ")" * 20_000, "`" + "${`" * 3000 + "`}" * 3000 + "`", "/" * 50_000, "<" * 50_000, "'" * 50_001):
        for language in ("javascript", "rust", "cpp", "tsx"):
            try:
                tokens(hard, language)
            except SyntaxError:
                pass
