"""What front-ends emit: node and edge rows of one file, with ids that depend on the file alone."""

from __future__ import annotations

import json


class Scope:
    """Names to node ids, innermost first."""

    def __init__(self):
        self.stack: list[dict[str, str]] = [{}]

    def push(self) -> None:
        self.stack.append({})

    def pop(self) -> None:
        self.stack.pop()

    def define(self, name: str, node: str) -> None:
        self.stack[-1][name] = node

    def lookup(self, name: str) -> str | None:
        return next((s[name] for s in reversed(self.stack) if name in s), None)


class Emitter:
    """Collects rows; ``seq`` is the order of emission in the file."""

    def __init__(self, file: str):
        self.file, self.nodes, self.edges, self.n = file, [], [], 0

    def _node(self, kind: str, name: str, line: int | None, col: int | None, scope: str | None, end: tuple[int, int] | None = None, contains: bool = True, **attrs) -> str:
        node = f"{kind}:{self.file}:{line}:{col}:{self.n}"
        attrs = {k: v for k, v in attrs.items() if v is not None}
        self.nodes.append((node, kind, name, self.file, line, col, *(end or (None, None)), scope, json.dumps(attrs) if attrs else None, self.n))
        self.n += 1
        if scope is not None and contains:
            self.edge(scope, node, "contains")
        return node

    def edge(self, src: str, dst: str, kind: str, **attrs) -> None:
        self.edges.append((src, dst, kind, attrs.get("field_name"), attrs.get("interprocedural"), json.dumps(attrs) if attrs else None, self.n))
        self.n += 1

    def module(self, name: str, end: tuple[int, int] | None = None) -> str:
        return self._node("module", name, 1, 0, None, end)

    def class_(self, name, at, scope, end=None, bases=None) -> str:
        return self._node("class", name, *at, scope, end, bases=bases or None)

    def function(self, name, at, scope, end=None, is_async=False, decorators=None) -> str:
        return self._node("function", name, *at, scope, end, is_async=is_async, decorators=decorators or None)

    def parameter(self, name, at, scope, position, type_annotation=None) -> str:
        node = self._node("parameter", name, *at, scope, contains=False, type_annotation=type_annotation, position=position)
        self.edge(scope, node, "has_parameter")
        return node

    def variable(self, name, at, scope, inferred_type=None) -> str:
        return self._node("variable", name, *at, scope, inferred_type=inferred_type)

    def call(self, name, at, scope, args, receiver_type=None) -> str:
        return self._node("call", name, *at, scope, args_count=args, receiver_inferred_type=receiver_type)

    def literal(self, raw, at, scope, kind) -> str:
        return self._node("literal", raw, *at, scope, literal_type=kind, raw_value=raw)

    def return_(self, at, scope) -> str:
        return self._node("return", "return", *at, scope)

    def import_(self, module, at, scope, names, is_from, aliases=None) -> str:
        return self._node("import", f"from {module}" if is_from else f"import {module}", *at, scope, module=module, names=names, is_from=is_from, aliases=aliases or None)

    def branch(self, at, scope, branch_type, has_else=False) -> str:
        return self._node("branch", branch_type, *at, scope, branch_type=branch_type, has_else=has_else)

    def loop(self, at, scope, loop_type, iterator_var=None) -> str:
        return self._node("loop", loop_type, *at, scope, loop_type=loop_type, iterator_var=iterator_var)

    def data_flow(self, src, dst, field_name=None) -> None:
        self.edge(src, dst, "data_flows_to", **({"field_name": field_name} if field_name else {}))

    def branches_to(self, branch, first) -> None:
        """Control enters ``first`` from a branch or loop."""
        self.edge(branch, first, "branches_to")

    def flows_to(self, src, dst) -> None:
        """Control goes from one statement to the next."""
        self.edge(src, dst, "flows_to")

    def definition(self, variable, by) -> None:
        self.edge(variable, by, "defined_by")

    def usage(self, variable, at) -> None:
        self.edge(variable, at, "used_by")
