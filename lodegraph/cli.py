"""The command line. Graphs are Parquet folders, or single JSON documents (``*.json``)."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import config
from .graph import Graph
from .operators import change, filters, pattern, taint, traverse
from .sinks import documents
from .sources import build, files, graphs, rules

VERSION = "0.1.0"


def _spark() -> SparkSession:
    s = SparkSession.builder.appName("lodegraph").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


def _load(path: str) -> Graph:
    spark = _spark()
    return graphs.read_json(spark, path) if path.endswith(".json") else documents.read_parquet(spark, path)


def _save(g: Graph, path: str) -> None:
    if path.endswith(".json"):
        _write(documents.to_json(g), path)
    else:
        documents.write_parquet(g, path, "overwrite")


_OVERLAY_HELP = "a JSON file: a list of {name, nodes: {id: style}, edges: [{source, target, ...style}]}"


def _write(text: str, path: str | None) -> None:
    if not path or path == "-":
        print(text)
        return
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(text)


def _show(df: DataFrame, a: argparse.Namespace) -> None:
    _write(documents.format_rows(df, a.output_format), getattr(a, "output", None))


_NODE = ["id", "kind", "name", "file", "line", "col", "end_line", "end_col", "scope"]


def _build(a) -> None:
    g, errors = build.build(files.scan(_spark(), a.root, a.exclude or config.load()["exclude"], a.language or config.load()["languages"] or None), lambda phase: print(phase, file=sys.stderr), a.timeout)
    for r in errors.toLocalIterator():
        print(f"skipped {r.path}: {r.error}", file=sys.stderr)
    _save(g, a.output)


def _info(a) -> None:
    g = _load(a.graph)
    for df in (g.counts(), filters.count_by_kind(g.nodes), filters.count_by_kind(g.edges), filters.files_by_extension(g)):
        _show(df, a)


def _query(a) -> None:
    out = filters.query_nodes(_load(a.graph), a.kind, a.name, a.file, a.scope, a.annotation, a.annotation_value, 0 if a.count else a.offset, 0 if a.count else a.limit)
    print(out.count()) if a.count else _show(out.select(*_NODE), a)


def _edges(a) -> None:
    out = filters.query_edges(_load(a.graph), a.kind, a.source, a.target, 0 if a.count else a.offset, 0 if a.count else a.limit)
    if a.count:
        print(out.count())
        return
    cols = ["src", "dst", "kind", "source_name", "target_name"]
    for side, node in (("source", "src"), ("target", "dst")):
        file, line = filters.location_of_id(F.col(node))
        out = out.withColumns({f"{side}_file": F.coalesce(f"{side}_file", file), f"{side}_line": F.coalesce(f"{side}_line", line)})
        cols += [f"{side}_file", f"{side}_line"]
    _show(out.select(*cols), a)


def _diff(a) -> None:
    found = change.diff(_load(a.before), _load(a.after), a.prefix_before, a.prefix_after)
    for name, df in found.items():
        print(f"# {name}")
        _show(df.orderBy(*df.columns), a)


def _annotate(a) -> None:
    g, counts = change.annotate(_load(a.graph), rules.annotation_rules(a.rules))
    _save(g, a.output)
    _write(documents.format_rows(counts.orderBy("rule"), a.output_format), None)  # the output is the graph's


def _pattern(a) -> None:
    _show(pattern.match_chain(_load(a.graph), rules.pattern(a.pattern), a.limit).select(F.array_join("chain", " -> ").alias("chain")), argparse.Namespace(**vars(a)))


def _subgraph(a) -> None:
    g = _load(a.graph)
    by = g.nodes.where(F.col("id") == a.root) if a.root else g.nodes.where((F.col("kind") == "function") & (F.col("name") == a.function)) if a.function else g.nodes.where((F.col("kind") == "class") & (F.col("name") == a.class_)) if a.class_ else g.nodes.where((F.col("kind") == "module") & F.contains("file", F.lit(a.file or "")))
    root = by.orderBy("seq", "id").first()
    if root is None:
        raise ValueError("no root found")
    _save(traverse.subgraph(g, root.id, a.edge_kind, a.depth), a.output)


def _taint(a) -> None:
    g = _load(a.graph)
    models = [m for name in a.models or [] for m in (rules.builtin_models(name) if name in rules.BUILTIN_MODELS else rules.load_models(name))]
    result = taint.run(g, rules.policy(*a.policy, models=models, implicit_params=a.implicit_params))
    p = result.paths if a.show_sanitized else result.paths.where("not is_sanitized")
    _show(p.orderBy("origin", "sink"), a)
    if a.apply:
        _save(result.apply_to(g), a.apply)


def _viz(a) -> None:
    g = _load(a.graph)
    if (n := g.nodes.count()) > 500:
        print(f"{n} nodes; consider --exclude-kind", file=sys.stderr)
    overlays = json.loads(Path(a.overlay).read_text()) if a.overlay else None
    _write(documents.to_html(g, a.title, a.exclude_kind, overlays=overlays), a.output)


def _dot(a) -> None:
    _write(documents.to_dot(_load(a.graph), edge_kinds=a.edge_kind, node_kinds=a.node_kind), a.output)


def _serve(a) -> None:
    from .sinks.http import server

    server(_load(a.graph), a.host, a.port).serve_forever()


def _watch(a) -> None:
    from .streaming.watch import watch

    watch(_spark(), a.root, a.output, a.checkpoint, a.exclude, f"{a.interval} seconds", told=lambda c: print(documents.format_rows(c))).awaitTermination()


def _config(a) -> None:
    path = config.user_file() if a.globally else config.project_file() or Path(config.NAME)
    if a.action == "show":
        _write(json.dumps(config.load(), indent=2), None)
    elif a.action == "init":
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("# settings: " + ", ".join(config.DEFAULTS) + "\n")
    else:
        config.change(path, a.key, json.loads(a.value) if a.action == "set" and a.value[:1] in '[{"0123456789tfn' else a.value if a.action == "set" else None)


def _completions(a) -> None:
    commands = next(x for x in parser()._actions if isinstance(x, argparse._SubParsersAction)).choices
    flags = {n: sorted(o for x in c._actions for o in x.option_strings if o.startswith("--")) for n, c in commands.items()}
    names = " ".join(flags)
    cases = "\n".join(f"    {n}) opts='{' '.join(f)}' ;;" for n, f in flags.items())
    if a.shell == "bash":
        body = f"_lodegraph() {{\n  local opts='{names}'\n  if [ $COMP_CWORD -gt 1 ]; then\n  case ${{COMP_WORDS[1]}} in\n{cases}\n  esac\n  fi\n  COMPREPLY=($(compgen -f -W \"$opts\" -- \"${{COMP_WORDS[COMP_CWORD]}}\"))\n}}\ncomplete -F _lodegraph lodegraph"
    elif a.shell == "zsh":
        body = f"#compdef lodegraph\nlocal opts='{names}'\nif (( CURRENT > 2 )); then\n  case $words[2] in\n{cases}\n  esac\nfi\ncompadd -- ${{=opts}}\n_files"
    else:
        lines = [f"complete -c lodegraph -n __fish_use_subcommand -a {n}" for n in flags]
        body = "\n".join([*lines, *(f"complete -c lodegraph -n '__fish_seen_subcommand_from {n}' -l {o[2:]}" for n, f in flags.items() for o in f)])
    print(body)


COMMANDS = {n: f for n, f in (("build", _build), ("info", _info), ("query", _query), ("edges", _edges), ("diff", _diff), ("annotate", _annotate), ("pattern", _pattern), ("subgraph", _subgraph), ("taint", _taint), ("viz", _viz), ("dot", _dot), ("serve", _serve), ("watch", _watch), ("config", _config), ("completions", _completions))}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lodegraph")
    p.add_argument("--version", action="version", version=VERSION)
    p.add_argument("--json-errors", action="store_true")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, *args: str, graph: bool = True, output: bool = False) -> argparse.ArgumentParser:
        c = sub.add_parser(name)
        if graph:
            c.add_argument("graph")
        for x in args:
            c.add_argument(x)
        if output:
            c.add_argument("-o", "--output", required=name in ("build", "annotate", "subgraph", "watch"))
        c.add_argument("--output-format", default=config.DEFAULTS["output_format"], choices=["table", "json", "jsonl", "csv", "tsv"])
        return c

    many = {"action": "append"}
    c = add("build", "root", graph=False, output=True)
    c.add_argument("--exclude", **many)
    c.add_argument("--language", **many)
    c.add_argument("--timeout", type=float, help="seconds, looked at after each phase")
    add("info")
    c = add("query", output=True)
    for x in ("--name", "--file", "--scope", "--annotation", "--annotation-value"):
        c.add_argument(x)
    e = add("edges", output=True)
    e.add_argument("--source")
    e.add_argument("--target")
    for x in (c, e):
        x.add_argument("--kind", **many)
        x.add_argument("--count", action="store_true")
        x.add_argument("--limit", type=int, default=50)
        x.add_argument("--offset", type=int, default=0)
    c = add("diff", "before", "after", graph=False)
    c.add_argument("--prefix-before")
    c.add_argument("--prefix-after")
    add("annotate", "rules", output=True)
    add("pattern", "pattern", output=True).add_argument("--limit", type=int, default=50)
    c = add("subgraph", output=True)
    for x in ("--root", "--function", "--file"):
        c.add_argument(x)
    c.add_argument("--class", dest="class_")
    c.add_argument("--depth", type=int, default=10)
    c.add_argument("--edge-kind", **many)
    c = add("taint", output=True)
    c.add_argument("--policy", required=True, **many)
    c.add_argument("--models", **many)
    c.add_argument("--show-sanitized", action="store_true")
    c.add_argument("--implicit-params", action="store_true")
    c.add_argument("--apply", metavar="GRAPH")
    c = add("viz", output=True)
    c.add_argument("--title", default="Graph")
    c.add_argument("--overlay", help=_OVERLAY_HELP)
    c.add_argument("--exclude-kind", **many)
    c = add("dot", output=True)
    c.add_argument("--edge-kind", **many)
    c.add_argument("--node-kind", **many)
    c = add("serve")
    c.add_argument("--host", default="127.0.0.1")
    c.add_argument("--port", type=int, default=8080)
    c = add("watch", "root", graph=False, output=True)
    c.add_argument("--checkpoint", required=True)
    c.add_argument("--interval", type=float, default=2)
    c.add_argument("--exclude", **many)
    c = sub.add_parser("config")
    c.add_argument("action", choices=["show", "init", "set", "unset"])
    c.add_argument("key", nargs="?")
    c.add_argument("value", nargs="?")
    c.add_argument("--global", dest="globally", action="store_true")
    sub.add_parser("completions").add_argument("shell", choices=["bash", "zsh", "fish"])
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    try:
        COMMANDS[a.command](a)
    except KeyboardInterrupt:
        return 130
    except Exception as x:  # noqa: BLE001  Spark's errors too end in a message, not in a stack trace
        message = str(x).split("\nJVM stacktrace")[0].strip()
        print(json.dumps({"error": type(x).__name__, "message": message}) if a.json_errors else f"error: {message}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
