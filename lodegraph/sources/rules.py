"""Rule files: taint policies, patterns, annotation rules, and propagation models."""

from __future__ import annotations

from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.change import rule_test
from ..operators.pattern import Chain, Step
from ..operators.taint import Policy
from ..schema import EDGE_KINDS, NODE_KINDS


def _load(path: str) -> Any:
    import yaml

    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f)


def _mapping(path: str) -> dict:
    data = _load(path) or {}
    if not isinstance(data, dict):
        raise ValueError(f"{path}: a mapping is expected")
    return data


def _test(rule: dict) -> Column:
    return rule_test(rule.get("kind"), rule.get("name"), rule.get("attr"))


def _any(rules: list[dict]) -> Column:
    out = F.lit(False)
    for r in rules:
        out = out | _test(r)
    return out


def policy(*paths: str, models: list[dict] | None = None, implicit_params: bool = False) -> Policy:
    """One policy from files whose lists are put one after another; the first source rule that matches
    names the label. Models act as propagators after the files' own."""
    parts: dict[str, list] = {"sources": [], "sinks": [], "sanitizers": [], "propagators": []}
    for p in paths:
        data = _mapping(p)
        for k in parts:
            parts[k] += data.get(k) or []
    label = F.lit(None).cast("string")
    for r in reversed(parts["sources"]):
        label = F.when(_test(r), F.lit(r.get("label", "tainted"))).otherwise(label)
    steps = [(_test({"kind": "call"} | (r.get("match") or {})), bool(r.get("param_to_return") or r.get("params_to_return"))) for r in parts["propagators"]]
    steps += [(F.col("name").isin(m["names"]), bool(m["params_to_return"])) for m in models or []]
    return Policy(label, _any(parts["sinks"]), _any(parts["sanitizers"]), tuple(steps), implicit_params)


def pattern(path: str) -> Chain:
    """A chain from a file with ``steps`` and an optional ``edge_kind``."""
    data = _mapping(path)
    steps = data.get("steps")
    if not isinstance(steps, list) or not steps:
        raise ValueError(f"{path}: steps are missing")
    kind = data.get("edge_kind")
    if kind is not None and kind.lower() not in EDGE_KINDS:
        raise ValueError(f"{path}: unknown edge kind {kind!r}")
    out = []
    for s in steps:
        if not isinstance(s, dict):
            raise ValueError(f"{path}: a step is a mapping")
        if s.get("kind") is not None and s["kind"].lower() not in NODE_KINDS:
            raise ValueError(f"{path}: unknown node kind {s['kind']!r}")
        value = s.get("annotation_value")
        out.append(Step(s.get("kind"), s.get("name_pattern", s.get("name")), s.get("annotation_key"), None if value is None else str(value), bool(s.get("wildcard"))))
    return Chain(out, kind)


def annotation_rules(path: str) -> list[dict]:
    rules = _mapping(path).get("annotations")
    if not isinstance(rules, list):
        raise ValueError(f"{path}: annotations are missing")
    return rules


# Library functions whose result carries the argument at position 0 (or, after "=", at
# those positions). Names after a slash are other names of the same function.
STDLIB = """
json.loads/loads json.dumps/dumps json.load/load json.dump/dump
pickle.loads pickle.dumps pickle.load pickle.dump
os.path.join/join=0,1 os.path.abspath/abspath os.path.basename/basename os.path.dirname/dirname os.path.normpath/normpath
shlex.split shlex.quote
subprocess.run subprocess.call subprocess.check_output subprocess.Popen
urllib.parse.urljoin/urljoin=0,1 urllib.parse.quote urllib.parse.unquote/unquote urllib.parse.urlencode/urlencode
base64.b64encode/b64encode base64.b64decode/b64decode base64.urlsafe_b64encode/urlsafe_b64encode base64.urlsafe_b64decode/urlsafe_b64decode
"""
BUILTINS = """
str repr bytes list tuple dict set sorted reversed enumerate
format/str.format join/str.join replace/str.replace strip/str.strip lstrip/str.lstrip rstrip/str.rstrip lower/str.lower upper/str.upper
encode/str.encode decode/bytes.decode split/str.split get/dict.get
"""
BUILTIN_MODELS = {"python-stdlib": STDLIB, "python-builtins": BUILTINS}


def builtin_models(name: str) -> list[dict]:
    """Models ``{"names": [...], "params_to_return": [...]}`` of a built-in set."""
    if name not in BUILTIN_MODELS:
        raise ValueError(f"unknown models {name!r}; there are {', '.join(sorted(BUILTIN_MODELS))}")
    out = []
    for word in BUILTIN_MODELS[name].split():
        names, _, positions = word.partition("=")
        out.append({"names": names.split("/"), "params_to_return": [int(x) for x in (positions or "0").split(",")]})
    return out


def load_models(path: str) -> list[dict]:
    """Models from a file of schema version 1."""
    data = _mapping(path)
    if data.get("schema_version") != 1:
        raise ValueError(f"{path}: schema_version 1 is expected")
    out = []
    for f in data.get("functions") or []:
        if not f.get("name"):
            raise ValueError(f"{path}: a function without a name")
        positions = (f.get("propagation") or {}).get("params_to_return") or []
        out.append({"names": [f["name"], *(f.get("aliases") or [])], "params_to_return": list(positions)})
    return out


def models_table(spark: SparkSession, models: list[dict]) -> DataFrame:
    """Rows ``(name, params_to_return, priority)``."""
    rows = [(n, m["params_to_return"], i) for i, m in enumerate(models) for n in m["names"]]
    return spark.createDataFrame(rows, "name string, params_to_return array<int>, priority int")


def find_config(start: str, name: str = ".lodegraph.yaml") -> str | None:
    """The nearest file of that name in ``start`` or a folder above it."""
    at = Path(start).resolve()
    for d in (at, *at.parents):
        if (d / name).is_file():
            return str(d / name)
    return None
