"""The Python front-end, on the standard library's parser.

An assignment emits its variable, then defined_by and data_flows_to with what the right side yields. A
name yields the node of its current definition; calls yield themselves, fed by their arguments and
receiver; attributes and subscripts yield a variable fed by what they read; other operators yield their
left side. ``match`` and ``try`` only lead to their statements."""

from __future__ import annotations

import ast
from pathlib import PurePosixPath

from .emitter import Emitter, Scope

_LITERALS = {str: "str", bytes: "bytes", int: "int", float: "float", complex: "complex", bool: "bool", type(None): "none"}


class PythonVisitor:
    def __init__(self, path: str, text: str):
        self.e, self.s, self.text = Emitter(path), Scope(), text
        self.types: list[dict[str, str]] = [{}]
        self.returns: dict[str, str] = {}
        self.classes: list[str] = []
        self.path = path

    def run(self) -> Emitter:
        tree = ast.parse(self.text)
        for f in ast.walk(tree):
            if isinstance(f, (ast.FunctionDef, ast.AsyncFunctionDef)) and f.returns is not None:
                self.returns[f.name] = self._type(f.returns)
        module = self.e.module(PurePosixPath(self.path).stem, (len(self.text.splitlines()) or 1, 0))
        self._body(tree.body, module)
        return self.e

    # -- statements -------------------------------------------------------------------------------

    def _body(self, body: list[ast.stmt], scope: str) -> None:
        for s in body:
            getattr(self, f"_{type(s).__name__}", self._other)(s, scope)

    def _other(self, node: ast.AST, scope: str) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.stmt):
                self._body([child], scope)
            elif isinstance(child, ast.expr):
                self._value(child, scope)
            else:
                self._other(child, scope)

    def _ClassDef(self, node: ast.ClassDef, scope: str) -> None:
        c = self.e.class_(node.name, _at(node), scope, _end(node), [ast.unparse(b) for b in node.bases])
        self.s.define(node.name, c)
        self.s.push()
        self.classes.append(node.name)
        self._body(node.body, c)
        self.classes.pop()
        self.s.pop()

    def _FunctionDef(self, node: ast.FunctionDef | ast.AsyncFunctionDef, scope: str) -> None:
        f = self.e.function(node.name, _at(node), scope, _end(node), isinstance(node, ast.AsyncFunctionDef), [ast.unparse(d) for d in node.decorator_list])
        self.s.define(node.name, f)
        self.s.push()
        self.types.append({})
        a = node.args
        every = [(x, "") for x in (*a.posonlyargs, *a.args)] + ([(a.vararg, "*")] if a.vararg else []) + [(x, "") for x in a.kwonlyargs] + ([(a.kwarg, "**")] if a.kwarg else [])
        position = 0
        for x, prefix in every:
            if not prefix and x.arg in ("self", "cls") and self.classes:
                self.types[-1][x.arg] = self.classes[-1]
                continue
            p = self.e.parameter(prefix + x.arg, _at(x), f, position, ast.unparse(x.annotation) if x.annotation else None)
            self.s.define(x.arg, p)
            if x.annotation:
                self.types[-1][x.arg] = self._type(x.annotation)
            position += 1
        self._body(node.body, f)
        self.types.pop()
        self.s.pop()

    _AsyncFunctionDef = _FunctionDef

    def _bind(self, target: ast.expr, value: str | None, scope: str, inferred: str | None) -> None:
        if isinstance(target, (ast.Tuple, ast.List)):
            for t in target.elts:
                self._bind(t.value if isinstance(t, ast.Starred) else t, value, scope, None)
            return
        if isinstance(target, ast.Subscript):
            self._value(target.value, scope)
            name = ast.unparse(target.value)
        else:
            name = target.id if isinstance(target, ast.Name) else ast.unparse(target)
        v = self.e.variable(name, _at(target), scope, inferred)
        if value:
            self.e.definition(v, value)
            self.e.data_flow(value, v)
        self.s.define(name, v)
        if inferred:
            self.types[-1][name] = inferred

    def _Assign(self, node: ast.Assign, scope: str) -> None:
        for t in node.targets:
            value = self._value(node.value, scope)
            self._bind(t, value, scope, self._inferred(node.value))

    def _AnnAssign(self, node: ast.AnnAssign, scope: str) -> None:
        value = self._value(node.value, scope) if node.value else None
        self._bind(node.target, value, scope, self._type(node.annotation))

    def _AugAssign(self, node: ast.AugAssign, scope: str) -> None:
        self._bind(node.target, self._value(node.value, scope), scope, None)

    def _Return(self, node: ast.Return, scope: str) -> None:
        r = self.e.return_(_at(node), scope)
        if node.value and (v := self._value(node.value, scope)):
            self.e.data_flow(v, r)

    def _Import(self, node: ast.Import, scope: str) -> None:
        for n in node.names:
            i = self.e.import_(n.name, _at(node), scope, [n.name], False, {n.name: n.asname} if n.asname else None)
            self.s.define(n.asname or n.name.split(".")[0], i)

    def _ImportFrom(self, node: ast.ImportFrom, scope: str) -> None:
        module = "." * node.level + (node.module or "")
        i = self.e.import_(module, _at(node), scope, [n.name for n in node.names], True, {n.name: n.asname for n in node.names if n.asname})
        for n in node.names:
            self.s.define(n.asname or n.name, i)

    def _If(self, node: ast.If, scope: str) -> None:
        b = self.e.branch(_at(node), scope, "if", bool(node.orelse))
        self._value(node.test, b)
        self._body(node.body, b)
        self._body(node.orelse, b)

    def _For(self, node: ast.For | ast.AsyncFor, scope: str) -> None:
        loop = self.e.loop(_at(node), scope, "for", ast.unparse(node.target))
        source = self._value(node.iter, loop)
        self._bind(node.target, source, loop, None)
        self._body(node.body, loop)
        self._body(node.orelse, loop)

    _AsyncFor = _For

    def _While(self, node: ast.While, scope: str) -> None:
        loop = self.e.loop(_at(node), scope, "while")
        self._value(node.test, loop)
        self._body(node.body, loop)
        self._body(node.orelse, loop)

    def _With(self, node: ast.With | ast.AsyncWith, scope: str) -> None:
        for item in node.items:
            v = self._value(item.context_expr, scope)
            if item.optional_vars is not None:
                self._bind(item.optional_vars, v, scope, self._inferred(item.context_expr))
        self._body(node.body, scope)

    _AsyncWith = _With

    def _Expr(self, node: ast.Expr, scope: str) -> None:
        self._value(node.value, scope)

    # -- expressions ------------------------------------------------------------------------------

    def _value(self, x: ast.expr, scope: str) -> str | None:
        """The node whose data the expression's value is; None if there is none."""
        kind = type(x)
        if kind is ast.Name:
            return self.s.lookup(x.id)
        if kind is ast.Constant:
            return self.e.literal(ast.get_source_segment(self.text, x) or repr(x.value), _at(x), scope, _LITERALS.get(type(x.value), "other"))
        if kind is ast.Call:
            return self._call(x, scope)
        if kind is ast.Attribute:
            base = self._value(x.value, scope)
            v = self.e.variable(ast.unparse(x), _at(x), scope)
            if base:
                self.e.data_flow(base, v, x.attr)
            return v
        if kind is ast.Subscript:
            base = self._value(x.value, scope)
            self._value(x.slice, scope)
            v = self.e.variable(ast.unparse(x), _at(x), scope)
            if base:
                self.e.data_flow(base, v)
            return v
        if kind is ast.JoinedStr:
            parts = [self._value(p.value, scope) for p in x.values if isinstance(p, ast.FormattedValue)]
            return self._merge("f-string", x, parts, scope)
        if kind is ast.BinOp:
            left, right = self._value(x.left, scope), self._value(x.right, scope)
            if isinstance(x.op, ast.Mod) and isinstance(x.left, (ast.Constant, ast.JoinedStr)) and isinstance(getattr(x.left, "value", ""), str):
                return self._merge("%", x, [left, right], scope)
            return left
        if kind in (ast.BoolOp, ast.Tuple, ast.List, ast.Set):
            found = [self._value(v, scope) for v in (x.values if kind is ast.BoolOp else x.elts)]
            return next((f for f in found if f), None)
        if kind is ast.Dict:
            for v in (*x.keys, *x.values):
                if v is not None:
                    self._value(v, scope)
            return None
        if kind is ast.IfExp:
            self._value(x.test, scope)
            a, b = self._value(x.body, scope), self._value(x.orelse, scope)
            return a or b
        if kind in (ast.Await, ast.Starred, ast.YieldFrom, ast.FormattedValue):
            return self._value(x.value, scope)
        if kind is ast.NamedExpr:
            v = self._value(x.value, scope)
            self._bind(x.target, v, scope, self._inferred(x.value))
            return self.s.lookup(x.target.id)
        for child in ast.iter_child_nodes(x):  # comparisons, comprehensions and others yield nothing
            if isinstance(child, ast.expr):
                self._value(child, scope)
            elif isinstance(child, ast.comprehension):
                source = self._value(child.iter, scope)
                self._bind(child.target, source, scope, None)
                for t in child.ifs:
                    self._value(t, scope)
        return None

    def _merge(self, name: str, x: ast.expr, parts: list[str | None], scope: str) -> str:
        c = self.e.call(name, _at(x), scope, len(parts))
        for p in parts:
            if p:
                self.e.data_flow(p, c)
        return c

    def _call(self, x: ast.Call, scope: str) -> str:
        receiver, owner = None, None
        if isinstance(x.func, ast.Attribute):
            base = x.func.value
            inner = self._value(base, scope) if not isinstance(base, ast.Name) else self.s.lookup(base.id)
            receiver, owner = inner, self._inferred(base)
            name = f"{_chain(base)}.{x.func.attr}" if _chain(base) else x.func.attr
        else:
            name = x.func.id if isinstance(x.func, ast.Name) else ast.unparse(x.func)
            if not isinstance(x.func, ast.Name):
                self._value(x.func, scope)
        args = [a.value if isinstance(a, ast.Starred) else a for a in x.args] + [k.value for k in x.keywords]
        values = [(a, self._value(a, scope)) for a in args]
        c = self.e.call(name, _at(x), scope, len(args), owner)
        if receiver and not isinstance(x.func.value, ast.Name):
            self.e.data_flow(receiver, c)
        elif receiver and not receiver.startswith(("import:", "class:", "function:")):
            self.e.data_flow(receiver, c)
        for a, v in values:
            if v:
                self.e.data_flow(v, c)
                if isinstance(a, ast.Name):
                    self.e.usage(v, c)
        return c

    # -- types ------------------------------------------------------------------------------------

    def _type(self, annotation: ast.expr) -> str:
        text = annotation.value if isinstance(annotation, ast.Constant) and isinstance(annotation.value, str) else ast.unparse(annotation)
        return text.split("[")[0].strip()

    def _inferred(self, x: ast.expr) -> str | None:
        """The class of a value as far as names tell: a typed name, a constructor, an annotated result."""
        if isinstance(x, ast.Name):
            return next((t[x.id] for t in reversed(self.types) if x.id in t), None)
        if isinstance(x, ast.Call):
            name = x.func.id if isinstance(x.func, ast.Name) else x.func.attr if isinstance(x.func, ast.Attribute) else ""
            if name in self.returns:
                return self.returns[name]
            if name[:1].isupper():
                return name
        return None


def _chain(x: ast.expr) -> str | None:
    """Dotted text of names and attributes; a call counts as the name it calls."""
    if isinstance(x, ast.Name):
        return x.id
    if isinstance(x, ast.Attribute):
        base = _chain(x.value)
        return f"{base}.{x.attr}" if base else x.attr
    if isinstance(x, ast.Call):
        return _chain(x.func)
    return None


def _at(x: ast.AST) -> tuple[int, int]:
    return x.lineno, x.col_offset


def _end(x: ast.AST) -> tuple[int, int]:
    return x.end_lineno, x.end_col_offset


def parse(path: str, content: bytes) -> Emitter:
    return PythonVisitor(path, content.decode("utf-8", "replace")).run()
