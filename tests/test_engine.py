"""The graph engine on small hand-made graphs, random graphs and source snippets."""

import json
import random
import urllib.error
import urllib.request
from threading import Thread

import pytest
from pyspark.sql import functions as F

from lodegraph import cli
from lodegraph.functions import ranges, text
from lodegraph.graph import Graph
from lodegraph.operators import calls, change, filters, flow, pattern, taint, traverse
from lodegraph.plans.fixpoint import fixpoint
from lodegraph.sinks import documents
from lodegraph.sinks.http import server
from lodegraph.sources import brace_code, build, files, graphs, python_code, rules
from lodegraph.streaming import watch


def make(spark, nodes, edges):
    """nodes: (id, kind[, scope[, attrs]]), lines by order; edges: (src, dst[, kind[, field]])."""
    n = [(x[0], x[1], x[0], "test.py", i + 1, 0, x[2] if len(x) > 2 else None, json.dumps(x[3]) if len(x) > 3 else None, i) for i, x in enumerate(nodes)]
    e = [(x[0], x[1], x[2] if len(x) > 2 else "data_flows_to", x[3] if len(x) > 3 else None, i) for i, x in enumerate(edges)]
    return Graph.of(spark.createDataFrame(n, "id string, kind string, name string, file string, line int, col int, scope string, attrs string, seq long"), spark.createDataFrame(e, "src string, dst string, kind string, field_name string, seq long"))


def run(g, sanitizers=(), **kw):
    first = F.col("name").substr(1, 1)
    return taint.run(g, taint.Policy(F.when(first == "s", F.lit("L")), first == "k", F.col("name").isin(*sanitizers) if sanitizers else F.lit(False), **kw))


def paths(r):
    return {(x.origin, x.sink): x.is_sanitized for x in r.paths.collect()}


def test_access_and_change(spark):
    g = make(spark, [("m", "module"), ("f", "function", "m"), ("x", "variable", "f")], [("m", "f", "contains"), ("f", "x", "contains"), ("x", "x"), ("x", "x"), ("x", "gone"), ("x", "x", "data_flows_to", "fld")])
    assert g.edges.count() == 4 and g.counts().first().asDict() == {"nodes": 3, "edges": 4, "files": 1}
    assert g.edges.where("kind = 'data_flows_to' and dst = 'x'").first().field_name == "fld"
    x = g.node("x")
    assert [r.id for r in g.successors(x, "data_flows_to").collect()] == ["x"] * 3 and [r.id for r in g.successors(x).collect()] == ["x"]
    assert g.scope_of(x).first().id == "f" and [r.id for r in g.children_of(g.node("m")).collect()] == ["f"]
    assert g.has_edge("m", "f", "contains") and not g.has_edge("m", "x") and not g.has_node("gone")
    g = g.annotate_nodes(spark.createDataFrame([("f", "a", "1"), ("x", "a", "2")], "id string, key string, value string"))
    g = g.annotate_nodes(spark.createDataFrame([("f", "a", "3")], "id string, key string, value string"))
    g = g.annotate_edges(spark.createDataFrame([("f", "x", "k", "true")], "src string, dst string, key string, value string"))
    assert {(r.id, r.value) for r in g.node_annotations.collect()} == {("f", "3"), ("x", "2")}
    less = g.remove_nodes(g.node("f"))
    assert less.nodes.count() == 2 and less.edges.count() == 2 and less.node_annotations.count() == 1 and less.edge_annotations.count() == 0
    assert g.remove_edges(spark.createDataFrame([("x", "x")], "src string, dst string"), "data_flows_to").edges.count() == 3
    assert g.add_nodes(g.node("x").withColumn("name", F.lit("y"))).node("x").first().name == "y"


def test_fixpoint_and_reach_against_search(spark):
    rng = random.Random(0)
    for _ in range(2):
        edges = [(f"n{rng.randrange(14)}", f"n{rng.randrange(14)}") for _ in range(22)]
        g = make(spark, [(f"n{i}", "variable") for i in range(14)], edges)
        want = {}
        for i in range(14):
            seen, todo = set(), [f"n{i}"]
            while todo:
                for a, b in edges:
                    if a == todo[0] and b not in seen:
                        seen.add(b)
                        todo.append(b)
                todo.pop(0)
            want[f"n{i}"] = seen
        got = {}
        for r in traverse.reachable(g, g.nodes, ["data_flows_to"]).collect():
            got.setdefault(r.origin, set()).add(r.id)
        assert got == {k: v for k, v in want.items() if v}
        assert all(r.origin != r.id for r in traverse.reachable(g, g.nodes).collect())
        back = {(r.id, r.origin) for r in traverse.reachable(g, g.nodes, ["data_flows_to"], reverse=True).collect()}
        assert back == {(k, x) for k, v in want.items() for x in v}

        def simple(path, end, left):
            if path[-1] == end and len(path) > 1:
                yield tuple(path)
                return
            if left:
                for b in {b for a, b in edges if a == path[-1] and b not in path}:
                    yield from simple([*path, b], end, left - 1)

        assert {tuple(r.path) for r in traverse.paths_between(g, "n0", "n5", 5).collect()} == set(simple(["n0"], "n5", 5))
    assert fixpoint(spark.range(0).select(F.col("id")), lambda d: d).count() == 0


def test_paths_to_sink_and_subgraph(spark):
    g = make(spark, [(x, "variable") for x in "abcdk"], [("a", "b"), ("a", "c"), ("b", "k"), ("c", "k"), ("d", "d"), ("a", "b", "calls")])
    assert {"".join(r.path) for r in traverse.paths_to_sink(g, "k").collect()} == {"abk", "ack"}
    assert {"".join(r.path) for r in traverse.paths_to_sink(g, "k", cutoff=1).collect()} == {"bk", "ck"}
    assert traverse.paths_to_sink(g, "none").count() == 0 and traverse.paths_between(g, "a", "none").count() == 0
    s = traverse.subgraph(g, "a", ["data_flows_to"], 1)
    assert {r.id for r in s.nodes.collect()} == set("abc") and s.edges.count() == 2
    assert traverse.subgraph(g, "a", max_depth=0).nodes.count() == 1


def test_patterns(spark):
    g = make(spark, [("p", "parameter"), ("v", "variable"), ("w", "variable"), ("c", "call")], [("p", "v"), ("v", "w"), ("w", "c"), ("w", "v")])
    g = g.annotate_nodes(spark.createDataFrame([("c", "hot", "true")], "id string, key string, value string"))
    S, C = pattern.Step, pattern.Chain
    match = lambda *steps: {tuple(r.chain) for r in pattern.match_chain(g, C(list(steps), "data_flows_to")).collect()}
    assert match(S("parameter"), S("variable")) == {("p", "v")}
    assert match(S("parameter"), S(wildcard=True), S("call")) == {("p", "c")} == match(S(wildcard=True), S("parameter"), S(wildcard=True), S(wildcard=True), S("call"), S(wildcard=True))
    assert match(S("variable", "^v"), S(wildcard=True), S("variable")) == {("v", "w")}
    assert match(S(annotation="hot", value="True")) == {("c",)} and match(S(annotation="hot", value="x")) == set() == match(S(wildcard=True))


def test_filters(spark):
    g = make(spark, [("m", "module"), ("cls", "class", "m"), ("fn", "function", "cls"), ("v1", "variable", "fn"), ("v2", "variable", "m")], [("fn", "v1", "contains")])
    ids = lambda df: [r.id for r in df.collect()]
    assert ids(filters.query_nodes(g, ["VARIABLE"], scope="cls")) == ["v1"] and ids(filters.query_nodes(g, offset=1, limit=2)) == ["cls", "fn"]
    assert ids(filters.query_nodes(g, name="^v", file="test", limit=0)) == ["v1", "v2"]
    assert filters.query_edges(g, source="^f", target="1$").count() == 1 and filters.query_edges(g, ["calls"]).count() == 0
    assert {(r.id, r.ancestor) for r in filters.scope_ancestors(g.nodes).collect()} == {("cls", "m"), ("fn", "cls"), ("fn", "m"), ("v1", "fn"), ("v1", "cls"), ("v1", "m"), ("v2", "m")}
    f, line = spark.range(1).select(*(c.alias(n) for c, n in zip(filters.location_of_id(F.lit("call:a.py:7:2:9")), "fl"))).first()
    assert (f, line) == ("a.py", 7)


def test_control_flow(spark):
    g = make(spark, [("f", "function"), ("p", "parameter", "f"), ("b", "branch", "f"), ("b1", "call", "b"), ("b2", "call", "b"), ("l", "loop", "f"), ("l1", "variable", "l"), ("l2", "call", "l"), ("r", "return", "f"), ("z", "call", "f"), ("l3", "loop", "b"), ("l4", "call", "l3")], [])
    got = {(r.src, r.dst, r.kind) for r in flow.control_flow(g.nodes).collect()}
    assert got == {("p", "b", "flows_to"), ("b", "l", "flows_to"), ("l", "r", "flows_to"), ("b", "b1", "branches_to"), ("l", "l1", "branches_to"), ("l2", "l", "flows_to")}


def test_calls_summaries_and_flow_between(spark):
    nodes = [("m", "module"), ("f", "function", "m"), ("p0", "parameter", "f", {"position": 0}), ("p1", "parameter", "f", {"position": 1}), ("v", "variable", "f"), ("r", "return", "f"), ("a", "variable", "m"), ("b", "variable", "m"), ("c", "call", "m"), ("inner", "call", "f")]
    edges = [("f", "p0", "has_parameter"), ("p0", "v"), ("v", "r"), ("p1", "inner"), ("a", "c"), ("b", "c"), ("c", "f", "calls")]
    g = make(spark, nodes, edges)
    s = flow.summaries(g)
    assert {(r.function_id, r.position, r.reached_id) for r in s.collect()} == {("f", 0, "r"), ("f", 1, "inner")}
    called = g.edges_of("calls").select("src", "dst")
    assert {(r.src, r.dst) for r in flow.argument_flow(g, called).collect()} == {("a", "p0"), ("b", "p1")}
    assert {(r.src, r.dst) for r in flow.return_flow(g, called, s).collect()} == {("v", "c")}


def test_method_resolution_order(spark):
    nodes = [("A", "class", None, {"bases": ["B", "pkg.C"]}), ("B", "class", None, {"bases": ["D"]}), ("C", "class"), ("D", "class"), ("cm", "function", "C"), ("dm", "function", "D")]
    g = make(spark, nodes, [])
    g = g.add_nodes(g.nodes.where("id in ('cm', 'dm')").withColumn("name", F.lit("go")))
    c = spark.createDataFrame([("c1", "a.go", "A"), ("c2", "a.go", "B"), ("c3", "a.no", "A"), ("c4", "a.go", None)], "id string, name string, receiver_inferred_type string")
    assert {(r.call, r.fn) for r in calls.by_method(g, c).collect()} == {("c1", "cm"), ("c2", "dm")}


@pytest.mark.parametrize(
    ("edges", "sanitizers", "want"),
    [
        ([("s1", "k1")], [], {("s1", "k1"): False}),
        ([("s1", "x"), ("x", "k1")], ["x"], {("s1", "k1"): True}),
        ([("s1", "x"), ("s1", "y"), ("x", "k1"), ("y", "k1")], ["x"], {("s1", "k1"): False}),
        ([("s1", "x"), ("s1", "y"), ("x", "k1"), ("y", "k1")], ["x", "y"], {("s1", "k1"): True}),
        ([("s1", "x"), ("x", "y"), ("y", "x"), ("y", "k1")], [], {("s1", "k1"): False}),
        ([("s1", "k1"), ("s2", "k1")], [], {("s1", "k1"): False, ("s2", "k1"): False}),
        ([("s1", "x", "data_flows_to", "f"), ("x", "k1", "data_flows_to", "g"), ("x", "k2", "data_flows_to", "f")], [], {("s1", "k2"): False}),
    ],
)
def test_taint(spark, edges, sanitizers, want):
    r = run(make(spark, [(x, "variable") for x in ("s1", "s2", "x", "y", "k1", "k2")], edges), sanitizers)
    assert paths(r) == want


def test_taint_details(spark):
    g = make(spark, [("s1", "variable"), ("x", "variable"), ("y", "variable"), ("m", "variable"), ("k1", "call"), ("far", "variable")], [("s1", "x"), ("x", "m"), ("s1", "y"), ("y", "x"), ("m", "k1")])
    r = run(g, ["m"])
    assert [p.path for p in r.path_nodes().collect()] == [["s1", "x", "m", "k1"]]
    assert {(c.sink, c.sanitizer) for c in r.common().collect()} == {("k1", "m")}
    notes = {(a.id, a.key): a.value for a in r.annotations().collect()}
    assert {i: json.loads(notes[i, "taint_role"]) for i in ("s1", "x", "y", "m", "k1")} == {"s1": "source", "x": "intermediate", "y": "intermediate", "m": "sanitizer", "k1": "sink"}
    assert notes["k1", "taint_sanitized"] == "true" and ("far", "tainted") not in notes and notes["x", "taint_labels"] == '["L"]'
    done = r.apply_to(g)
    assert {(e.src, e.dst) for e in done.edge_annotations.where("key = 'tainted'").collect()} == {("s1", "x"), ("x", "m"), ("m", "k1")}


def test_taint_through_calls(spark):
    nodes = [("fn", "function"), ("p", "parameter", "fn", {"position": 0}), ("r", "return", "fn"), ("s1", "variable"), ("c", "call"), ("u", "call"), ("v", "variable"), ("w", "variable"), ("k1", "call"), ("k2", "call")]
    edges = [("p", "r"), ("s1", "c"), ("c", "fn", "calls"), ("v", "c", "defined_by"), ("v", "k1"), ("s1", "u"), ("w", "u", "defined_by"), ("w", "k2")]
    g = make(spark, nodes, edges)
    assert paths(run(g)) == {("s1", "k1"): False}
    assert paths(run(g, propagators=((F.col("name") == "u", True),))) == {("s1", "k1"): False, ("s1", "k2"): False}
    assert paths(run(g, propagators=((F.col("name") == "u", False), (F.lit(True), True)))) == {("s1", "k1"): False}
    labels = {(x.node, x.label) for x in run(g, implicit_params=True).labels_at.collect()}
    assert ("r", "param:p") in labels


def test_diff_and_rules(spark):
    a = make(spark, [("f", "function"), ("g", "function"), ("x", "variable")], [])
    b = make(spark, [("f", "function"), ("h", "function")], [])
    d = change.diff(a, b)
    assert {r.name for r in d["added"].collect()} == {"h"} and {r.name for r in d["removed"].collect()} == {"g"} and d["changed_files"].first().asDict() == {"file": "test.py", "before": 3, "after": 2}
    g, counts = change.annotate(a, [{"match": {"kind": "FUNCTION"}, "set": {"x": 1, "y": [True]}}, {"match": {"name": "^f"}, "set": {"x": "z"}}, {"match": {"kind": "bad"}, "set": {"q": 1}}])
    assert {(r.id, r.key): json.loads(r.value) for r in g.node_annotations.collect()} == {("f", "x"): "z", ("f", "y"): [True], ("g", "x"): 1, ("g", "y"): [True]}
    assert {r.rule: r.n for r in counts.collect()} == {0: 2, 1: 1}


def test_documents(spark, tmp_path):
    g = make(spark, [('a"\n', "module"), ("b", "call", 'a"\n', {"args_count": 2})], [('a"\n', "b", "contains"), ("b", "b", "data_flows_to", "f")])
    g = g.annotate_nodes(spark.createDataFrame([("b", "n", '{"x":[1,"y"]}'), ("b", "t", '"text"'), ("b", "o", "true")], "id string, key string, value string")).annotate_edges(spark.createDataFrame([("b", "b", "k", "1")], "src string, dst string, key string, value string"))
    document = documents.to_json(g)
    (tmp_path / "g.json").write_text(document)
    plain = lambda r: str({k: json.loads(v) if k == "attrs" and v else v for k, v in r.asDict().items()})
    show = lambda x: (sorted(map(plain, x.nodes.drop("seq").collect())), sorted(map(str, x.edges.drop("seq", "attrs").collect())), {(r.id, r.key): json.loads(r.value) for r in x.node_annotations.collect()}, {(r.src, r.key): json.loads(r.value) for r in x.edge_annotations.collect()})
    assert show(graphs.read_json(spark, str(tmp_path / "g.json"))) == show(g) == show(graphs.from_dict(spark, json.loads(document)))
    documents.write_parquet(g, str(tmp_path / "p"))
    assert show(documents.read_parquet(spark, str(tmp_path / "p"))) == show(g)
    dot = documents.to_dot(g)
    assert dot.startswith("digraph") and '\\"\\n' in dot and dot.count("->") == 2
    assert documents.to_dot(g, edge_kinds=["data_flows_to"]).count("shape=") == 1
    page = documents.to_html(g, "<t>", exclude_kinds=["module"])
    assert "&lt;t&gt;" in page and '"kind":"data_flows_to"' in page and '"kind":"contains"' not in page
    df = spark.createDataFrame([(1, None, "x,y")], "a int, b string, c string")
    assert documents.format_rows(df, "csv") == 'a,b,c\n1,,"x,y"' and json.loads(documents.format_rows(df, "jsonl"))["a"] == 1 and documents.format_rows(df).splitlines()[0] == "a  b  c"


def test_columns(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(text.normalised_path(F.lit("/r/a/b.py"), "/r")) == "a/b.py" and one(text.normalised_path(F.lit("/q/b.py"), "/r")) == "b.py"
    assert one(text.short_name(F.lit("a::b.c"))) == "c" and one(text.qualifier(F.lit("a::b.c"))) == "b" and one(text.extension(F.lit("x/y.tar.gz"))) == ".gz" and one(text.stem(F.lit("x/.hid"))) == ".hid"
    for path, want in (("a/node_modules/b.js", True), ("venvx/a.py", False), ("gen_a.py", True), ("x/gen_b.py", True), ("b.py", False)):
        assert one(text.excluded(F.lit(path), [*files.DEFAULT_EXCLUDES, "gen_[ab].py"])) is want
    loc = lambda line, col=0, file="f": ranges.location(F.lit(file), F.lit(line), F.lit(col))
    span = lambda a, b: F.struct(loc(a).alias("start"), loc(b).alias("end"))
    assert one(ranges.contains(span(1, 3), loc(3))) and not one(ranges.contains(span(1, 3), loc(3, 1))) and not one(ranges.contains(span(1, 3), loc(2, 0, "g")))
    assert one(ranges.overlaps(span(1, 3), span(3, 4))) and not one(ranges.overlaps(span(1, 2), span(3, 4)))


LIB = "def helper(q):\n    r = q\n    return r\n"
APP = 'from lib import helper as h\nclass Base:\n    def go(self, x):\n        return x\nclass App(Base):\n    def run(self, data):\n        a = App()\n        v = h(data)\n        w = a.go(v)\n        eval(w)\n        if w:\n            print(f"{w.name}")\n'


def test_python_build_and_rebuild(spark, tmp_path):
    for name, s in (("lib.py", LIB), ("app.py", APP), ("bad.py", "def ("), ("venv/x.py", "a = 1")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(s)
    found = files.scan(spark, str(tmp_path))
    assert {r.path for r in found.collect()} == {"lib.py", "app.py", "bad.py"}
    g, errors = build.build(found)
    assert [r.path for r in errors.collect()] == ["bad.py"]
    name = {r.id: r.name for r in g.nodes.collect()}
    assert {(name[r.src], name[r.dst]) for r in g.edges_of("calls").collect()} == {("h", "helper"), ("a.go", "go")}
    r = taint.run(g, taint.Policy(F.when(F.col("name") == "data", "user"), F.col("name") == "eval"))
    assert {(name[x.origin], name[x.sink]) for x in r.paths.collect()} == {("data", "eval")}
    before, _ = files.hashes(found), g.nodes.cache().count()
    snapshot = spark.createDataFrame(before.collect())
    saved = str(tmp_path / "g")
    documents.write_parquet(g, saved)
    (tmp_path / "lib.py").write_text(LIB.replace("helper", "other"))
    (tmp_path / "bad.py").unlink()
    g2, what, _ = build.rebuild(documents.read_parquet(spark, saved), snapshot, files.scan(spark, str(tmp_path)))
    assert {(r.path, r.change) for r in what.collect()} == {("lib.py", "changed"), ("bad.py", "deleted")}
    name = {r.id: r.name for r in g2.nodes.collect()}
    assert {(name[r.src], name[r.dst]) for r in g2.edges_of("calls").collect()} == {("a.go", "go")} and "helper" not in name.values()
    fresh, _ = build.build(files.scan(spark, str(tmp_path)))
    key = lambda x: sorted((r.src, r.dst, r.kind) for r in x.edges.collect())
    assert key(g2) == key(fresh)


def test_python_front_end():
    e = python_code.parse("m.py", b"def f(a, *b):\n    c = '%s' % a\n    d: int = g(c).h(a)\n    for x, y in d:\n        c += x\n    return [z for z in c]\n")
    name = {n[0]: n[2] for n in e.nodes}
    got = {(name[s], name[t], f) for s, t, k, f, *_ in e.edges if k == "data_flows_to"}
    assert {("a", "%", None), ("%", "c", None), ("c", "g", None), ("g", "g.h", None), ("a", "g.h", None), ("g.h", "d", None), ("d", "x", None), ("x", "c", None)} <= got
    assert [n[2] for n in e.nodes if n[1] == "parameter"] == ["a", "*b"] and len({n[0] for n in e.nodes}) == len(e.nodes)
    with pytest.raises(SyntaxError):
        python_code.parse("m.py", b"def (")


SNIPPETS = {
    "java": "class A extends B { String f(String x) { String q = \"a\" + x; C c = new C(q); if (q == null) { return q; } for (String s : c) { g(s); } return c.run(q); } }",
    "javascript": "function f(x) {\n const q = g(x)\n if (q) { h(q) }\n for (const s of q) { g(s) }\n return q\n}\nclass A extends B { m(y) { return y } }\nconst k = (z) => { return z }\n",
    "typescript": "interface I { a: string }\nclass A { f(x: string): string { const q: string = g(x); if (q) { h(q); } for (const s of q) { g(s); } return q; } }",
    "go": "package m\ntype A struct { x int }\nfunc (a *A) f(x int) int {\n q, r := g(x), 1\n if q > r { h(q) }\n for _, s := range q { g(s) }\n return q\n}\n",
    "rust": "struct A { x: i32 }\nimpl A { fn f(&self, x: i32) -> i32 { let q = g(&x); if q > 1 { h(q); } for s in q { g(s); } return q; } }",
    "c": "struct A { int x; };\nint f(int x) { int q = g(x); if (q) { h(q); } for (int i = 0; i < q; i++) { g(i); } return q; }",
    "cpp": "class A : public B { public: int f(int x) { int q = g(x); if (q) { h(q); } for (auto s : q) { g(s); } return q; } };",
}


@pytest.mark.parametrize("language", sorted(SNIPPETS))
def test_other_front_ends(language):
    e = brace_code.parse("x", SNIPPETS[language].encode(), language)
    kinds = {n[1] for n in e.nodes}
    assert {"module", "class", "function", "parameter", "variable", "call", "branch", "loop", "return"} <= kinds, kinds
    name = {n[0]: n[2] for n in e.nodes}
    got = {(name[s], name[t]) for s, t, k, *_ in e.edges if k == "data_flows_to"}
    assert ("q", "return") in got or ("c.run", "return") in got
    assert ("x", "g") in got or ("x", "<string_concat>") in got
    by = {n[0]: n for n in e.nodes}
    assert all(n[8] in by for n in e.nodes if n[8]) and all(s in by and t in by for s, t, *_ in e.edges)
    with pytest.raises(SyntaxError):
        brace_code.parse("x", b"f(", language)


def test_rule_files(spark, tmp_path):
    w = lambda n, s: (tmp_path / n).write_text(s) and str(tmp_path / n)
    p = rules.policy(w("p.yaml", "sources: [{kind: variable, name: ^s, label: a}]\nsinks: [{kind: nothing}, {name: ^k}]\n"), w("q.yaml", "sources: [{name: .}]\nsanitizers: [{attr: {clean: true}}]\n"), models=rules.builtin_models("python-stdlib"))
    g = make(spark, [("s1", "variable"), ("k1", "call"), ("z", "variable", None, {"clean": True}), ("loads", "call"), ("v", "variable"), ("k2", "call")], [("s1", "k1"), ("s1", "z"), ("s1", "loads"), ("v", "loads", "defined_by"), ("v", "k2")])
    r = taint.run(g, p)
    assert ("s1", "k2") in paths(r) and {x.label for x in r.seed.where("origin = 's1'").collect()} == {"a"} and [x.dst for x in r.edges.where("src = 's1' and not cut").orderBy("dst").collect()][-1] == "z"
    c = rules.pattern(w("c.yaml", "edge_kind: data_flows_to\nsteps: [{kind: variable, name: ^s}, {wildcard: true}, {kind: call}]\n"))
    assert pattern.match_chain(g, c).count() == 2
    for bad in ("steps: []", "steps: [{kind: x}]", "edge_kind: x\nsteps: [{kind: call}]", "- 1"):
        with pytest.raises(ValueError):
            rules.pattern(w("bad.yaml", bad))
    m = rules.load_models(w("m.yaml", "schema_version: 1\nfunctions: [{name: a.b, aliases: [b], propagation: {params_to_return: [1]}}]\n"))
    assert {(x.name, tuple(x.params_to_return)) for x in rules.models_table(spark, m).collect()} == {("a.b", (1,)), ("b", (1,))}
    assert len(rules.builtin_models("python-stdlib")) == 27 and len(rules.builtin_models("python-builtins")) == 22
    with pytest.raises(ValueError):
        rules.load_models(w("m2.yaml", "schema_version: 2"))


def test_http(spark):
    g = make(spark, [("a", "module"), ("b", "call", "a")], [("a", "b", "contains")])
    s = server(g, port=0)
    Thread(target=s.serve_forever, daemon=True).start()

    def get(path):
        try:
            with urllib.request.urlopen(f"http://127.0.0.1:{s.server_port}{path}") as r:
                return r.status, json.load(r)
        except urllib.error.HTTPError as x:
            return x.code, json.load(x)

    assert get("/health") == (200, {"status": "ok"}) and get("/info")[1]["nodes"] == 2
    assert [n["id"] for n in get("/query?kind=call")[1]["nodes"]] == ["b"] and get("/node/b")[1]["scope"] == "a"
    assert get("/edges?source=a")[1]["edges"][0]["dst"] == "b" and len(get("/subgraph?root=a")[1]["nodes"]) == 2
    assert [get(p)[0] for p in ("/node/x", "/none", "/subgraph", "/query?kind=bad", "/query?limit=x")] == [404, 404, 400, 400, 400]
    s.shutdown()


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.py").write_text("def f(x):\n    eval(x)\n")
    out, policy = str(tmp_path / "g.json"), tmp_path / "p.yaml"
    policy.write_text("sources: [{kind: parameter}]\nsinks: [{name: eval}]\n")
    assert cli.main(["build", str(tmp_path / "src"), "-o", out]) == 0
    capsys.readouterr()
    assert cli.main(["query", out, "--kind", "call", "--output-format", "json"]) == 0
    assert [n["name"] for n in json.loads(capsys.readouterr().out)] == ["eval"]
    assert cli.main(["edges", out, "--kind", "contains", "--count"]) == 0 and capsys.readouterr().out.strip() == "2"
    assert cli.main(["taint", out, "--policy", str(policy), "--output-format", "jsonl"]) == 0
    assert json.loads(capsys.readouterr().out)["is_sanitized"] is False
    assert cli.main(["subgraph", out, "--function", "f", "-o", str(tmp_path / "s.json")]) == 0 and cli.main(["dot", out]) == 0
    assert cli.main(["--json-errors", "subgraph", out, "--function", "none", "-o", "x.json"]) == 1
    assert json.loads(capsys.readouterr().err.strip().splitlines()[-1])["error"] == "ValueError"
    assert cli.main(["completions", "bash"]) == 0


def test_watch(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    (src / "a.py").write_text("x = 1\n")
    found = files.scan(spark, str(src))
    watch.save(build.build(found)[0], found, str(tmp_path / "g"), 0)
    assert watch.update(spark, str(src), str(tmp_path / "g"), 0) is None
    (src / "b.py").write_text("y = 2\n")
    assert [r.change for r in watch.update(spark, str(src), str(tmp_path / "g"), 0).collect()] == ["added"]
    assert {r.file for r in documents.read_parquet(spark, str(tmp_path / "g/v1")).files().collect()} == {"a.py", "b.py"}


def test_watch_sees_new_files_edits_and_deletions(spark, tmp_path):
    import time

    src, seen = tmp_path / "src", []
    src.mkdir()
    (src / "a.py").write_text("def f():\n    return 1\n")
    (src / "b.py").write_text("y = 2\n")
    query = watch.watch(spark, str(src), str(tmp_path / "g"), str(tmp_path / "c"), every="200 milliseconds", told=lambda df: seen.append({(r.path, r.change) for r in df.collect()}))
    try:
        for n, (path, text, change) in enumerate([("c.py", "z = 3\n", "added"), ("a.py", "def g():\n    return 2\n", "changed"), ("b.py", None, "deleted")]):
            (src / path).write_text(text) if text else (src / path).unlink()
            end = time.time() + 60
            while len(seen) <= n and time.time() < end and query.isActive:
                time.sleep(0.1)
            assert query.exception() is None and seen[n] == {(path, change)}
    finally:
        query.stop()
    g = documents.read_parquet(spark, str(tmp_path / "g/v3"))
    assert {r.file for r in g.files().collect()} == {"a.py", "c.py"} and {r.name for r in g.nodes_of("function").collect()} == {"g"}
    assert watch.latest(spark, str(tmp_path / "g")) == 3 and watch.latest(spark, str(tmp_path / "none")) is None


def test_build_reports_phases_and_times_out(spark):
    phases = []
    g, errors = build.build(files.inline(spark, {"b.py": "def f(x):\n    return x\n", "a.py": "f(1)\n", "c.c": "int f("}), phases.append)
    assert phases == ["parse", "control flow", "calls", "summaries", "data flow", "done"] and [r.path for r in errors.collect()] == ["c.c"]
    order = [r.file for r in g.nodes.where("kind = 'module'").orderBy("seq").collect()]
    assert order == ["a.py", "b.py"]
    with pytest.raises(TimeoutError, match="seconds before"):
        build.build(files.inline(spark, {"a.py": "f(1)\n"}), timeout=0.0)


def test_commands_beside_the_main_ones(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.chdir(tmp_path)
    at = lambda name: str(tmp_path / name)
    src = tmp_path / "src"
    src.mkdir()
    (src / "a.py").write_text("def f(x):\n    y = x\n    return eval(y)\n")
    assert cli.main(["build", str(src), "-o", at("a.json")]) == 0
    (src / "a.py").write_text("def g(x):\n    return eval(x)\n")
    assert cli.main(["build", str(src), "-o", at("b.json"), "--timeout", "900"]) == 0
    capsys.readouterr()
    assert cli.main(["info", at("a.json"), "--output-format", "csv"]) == 0 and "function,1" in capsys.readouterr().out
    assert cli.main(["diff", at("a.json"), at("b.json")]) == 0
    out = capsys.readouterr().out
    assert "# added" in out and "g" in out.split("# added")[1]
    (tmp_path / "r.yaml").write_text("annotations: [{match: {kind: call}, set: {risky: true}}]\n")
    code = cli.main(["annotate", at("a.json"), at("r.yaml"), "-o", at("c.json")])
    assert code == 0, capsys.readouterr().err
    assert any(v.get("risky") for v in json.loads((tmp_path / "c.json").read_text())["annotations"].values())
    (tmp_path / "p.yaml").write_text("edge_kind: data_flows_to\nsteps: [{kind: parameter}, {wildcard: true}, {kind: call, name: eval}]\n")
    capsys.readouterr()
    assert cli.main(["pattern", at("a.json"), at("p.yaml")]) == 0 and "->" in capsys.readouterr().out
    (tmp_path / "o.json").write_text(json.dumps([{"name": "hot", "nodes": {"x": {"shape": "diamond", "opacity": 0.5}}, "edges": [{"source": "x", "target": "y", "width": 3, "style": "dashed"}]}]))
    assert cli.main(["viz", at("a.json"), "--overlay", at("o.json"), "-o", at("v.html")]) == 0
    page = (tmp_path / "v.html").read_text()
    assert '"shape": "diamond"' in page and "overlays.forEach" in page and "%(" not in page
    assert cli.main(["config", "init"]) == 0 and cli.main(["config", "set", "output_format", "json"]) == 0
    assert cli.main(["config", "show"]) == 0 and '"output_format": "json"' in capsys.readouterr().out
    assert cli.main(["config", "unset", "output_format"]) == 0
    for shell in ("bash", "zsh", "fish"):
        assert cli.main(["completions", shell]) == 0 and "show-sanitized" in capsys.readouterr().out
    assert cli.main(["--json-errors", "info", str(tmp_path / "nothing")]) == 1
    err = capsys.readouterr().err
    assert "message" in json.loads(err[err.rindex('{"error"') :].splitlines()[0])


def test_annotate_keeps_the_graph_and_prints_the_counts(spark, tmp_path, capsys):
    at = lambda name: str(tmp_path / name)
    src = tmp_path / "src"
    src.mkdir()
    (src / "a.py").write_text("def f(x):\n    return eval(x)\n")
    (tmp_path / "r.yaml").write_text("annotations: [{match: {kind: call}, set: {risky: true}}]\n")
    assert cli.main(["build", str(src), "-o", at("graph")]) == 0
    capsys.readouterr()
    code = cli.main(["annotate", at("graph"), at("r.yaml"), "-o", at("marked"), "--output-format", "csv"])
    out = capsys.readouterr()
    assert code == 0 and out.out.split() == ["rule,n", "0,1"], out.err
    assert cli.main(["query", at("marked"), "--annotation", "risky", "--output-format", "csv"]) == 0
    assert "eval" in capsys.readouterr().out


def test_public_names():
    import lodegraph

    assert all(hasattr(lodegraph, n) for n in lodegraph.__all__)


def test_long_chains_and_many_rounds(spark):
    """Further than any registered query goes: a chain of 60 hops with a sanitizer half way."""
    g = make(spark, [("s", "variable"), *((f"n{i:02}", "call" if i == 30 else "variable") for i in range(60)), ("k", "call")], [("s", "n00"), *((f"n{i:02}", f"n{i + 1:02}") for i in range(59)), ("n59", "k")])
    r = taint.run(g, taint.Policy(F.when(F.col("name") == "s", "a"), F.col("name") == "k", F.col("name") == "n30"))
    assert [(p.origin, p.sink, p.depth, p.is_sanitized) for p in r.paths.collect()] == [("s", "k", 61, True)]
    assert r.path_nodes().first().path == ["s", *(f"n{i:02}" for i in range(60)), "k"]
    assert [x.sanitizer for x in r.common().collect()] == ["n30"]
