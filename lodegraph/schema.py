"""Kinds and table schemas of the graph.

``attrs`` and annotation values are JSON; ``seq`` is the order of emission, which decides wherever the
first or last of several rows wins."""

from __future__ import annotations

NODE_KINDS = ("module", "class", "function", "parameter", "variable", "call", "literal", "return", "import", "branch", "loop", "block")
EDGE_KINDS = ("contains", "has_parameter", "has_return_type", "flows_to", "branches_to", "data_flows_to", "defined_by", "used_by", "calls", "resolves_to", "imports")

NODES = "id string, kind string, name string, file string, line int, col int, end_line int, end_col int, scope string, attrs string, seq bigint"
EDGES = "src string, dst string, kind string, field_name string, interprocedural boolean, attrs string, seq bigint"
NODE_ANNOTATIONS = "id string, key string, value string, seq bigint"
EDGE_ANNOTATIONS = "src string, dst string, key string, value string, seq bigint"

#: Attributes that are read often, as columns of ``Graph.typed_nodes``.
ATTRS = "bases array<string>, is_async boolean, decorators array<string>, type_annotation string, position int, inferred_type string, args_count int, receiver_inferred_type string, literal_type string, raw_value string, module string, names array<string>, is_from boolean, aliases map<string,string>, branch_type string, has_else boolean, loop_type string, iterator_var string, source_text string"


def columns(schema: str) -> list[str]:
    """Column names of a schema string without nested types."""
    return [x.split()[0] for x in schema.split(", ")]
