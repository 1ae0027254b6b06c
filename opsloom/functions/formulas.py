"""What named aggregations in Python sources compute: one canonical text a formula, and how far it can be trusted.

A formula is printed once, top down, with the names of its surroundings resolved on the way: module constants, columns
that ``withColumn`` defines in the same function, wrappers that only name a column. Two formulas are the same if their texts are.
"""

from __future__ import annotations

import ast
import hashlib
from collections import Counter
from typing import NamedTuple

#: States of an extraction, names under which the functions module is known, wrappers of a column name.
EXTRACTED, PARTIAL, AMBIGUOUS, NOT_EXTRACTABLE = "extraida", "parcial", "ambigua", "nao_extraivel"
MODULES = {"F", "f", "sf", "func", "funcs", "functions"}
WRAPPERS = {"col", "column"}
#: How often a column is replaced by its definition.
DEEPEST = 3


class Metric(NamedTuple):
    metric_id: str
    formula: str
    canonical: str | None
    grain: str
    line: int
    status: str
    detail: str


class Scope(NamedTuple):
    """What names mean in a function: module constants, columns with their definitions, columns with several of them."""

    constants: dict[str, ast.Constant]
    columns: dict[str, ast.expr]
    several: set[str]


class Printer:
    """Prints expressions in a scope; ``free`` counts names left without a value, ``called`` names of functions, ``strings`` texts met."""

    def __init__(self, scope: Scope, deepest: int = DEEPEST):
        self.scope, self.deepest = scope, deepest
        self.free, self.called, self.strings = Counter(), set(), set()

    def text(self, node, depth: int = 0) -> str:
        if isinstance(node, list):
            return "[" + " ".join(self.text(x, depth) for x in node) + "]"
        if not isinstance(node, ast.AST):
            return repr(node)
        if isinstance(node, ast.Name):
            if node.id in self.scope.constants:
                return self.text(self.scope.constants[node.id], depth)
            self.free[node.id] += 1
            return f"<{node.id}>"
        if isinstance(node, ast.Constant):
            if isinstance(node.value, str):
                self.strings.add(node.value)
                if depth < self.deepest and node.value in self.scope.columns:
                    return self.text(self.scope.columns[node.value], depth + 1)
            return repr(node.value)
        if isinstance(node, ast.Call):
            return self.call(node, depth)
        fields = " ".join(self.text(getattr(node, name, None), depth) for name in node._fields if name not in ("ctx", "kind", "type_comment"))
        return f"({type(node).__name__} {fields})"

    def call(self, node: ast.Call, depth: int) -> str:
        """A method of the functions module is a plain function; of anything else, a function whose first argument that is."""
        args, func = list(node.args), node.func
        if isinstance(func, ast.Attribute):
            if func.attr in WRAPPERS and len(args) == 1:
                return self.text(args[0], depth)
            if not (isinstance(func.value, ast.Name) and func.value.id in MODULES):
                args.insert(0, func.value)
            name = func.attr
        elif isinstance(func, ast.Name) and func.id not in self.scope.constants:
            name = func.id
        else:
            return f"(Call {self.text(func, depth)} {self.text(args, depth)} {self.text(node.keywords, depth)})"
        self.called.add(name)
        return f"{name}({' '.join(self.text(a, depth) for a in args)}|{' '.join(f'{k.arg}={self.text(k.value, depth)}' for k in node.keywords)})"


def _is(node, method: str) -> bool:
    return isinstance(node, ast.Call) and isinstance(node.func, ast.Attribute) and node.func.attr == method


def _literal(node) -> str | None:
    return node.value if isinstance(node, ast.Constant) and isinstance(node.value, str) else None


def scope_of(function: ast.FunctionDef, constants: dict[str, ast.Constant]) -> Scope:
    """Columns of a function; one that has two different definitions stands for neither."""
    told: dict[str, dict[str, ast.expr]] = {}
    for node in ast.walk(function):
        if _is(node, "withColumn") and len(node.args) > 1 and (name := _literal(node.args[0])) is not None:
            told.setdefault(name, {})[ast.dump(node.args[1])] = node.args[1]
    return Scope(constants, {name: list(some.values())[-1] for name, some in told.items()}, {name for name, some in told.items() if len(some) > 1})


def grain_of(agg: ast.Call) -> list[str] | None:
    """Literal keys of the grouping that an aggregation ends; none without a grouping, null if a key is no literal."""
    node = agg.func
    while isinstance(node, ast.Attribute) and isinstance(node.value, ast.Call):
        call = node.value
        if _is(call, "groupBy"):
            keys = [_literal(a) for a in call.args]
            return None if call.keywords or None in keys else keys
        node = call.func
    return []


def metric_of(name: str, formula: ast.expr, keys: list[str] | None, scope: Scope) -> Metric:
    """One named aggregation and its state."""
    raw, line = ast.unparse(formula), formula.lineno
    flat = Printer(scope, 0)
    flat.text(formula)
    if both := sorted(flat.strings & scope.several):
        return Metric(name, raw, None, ",".join(keys or []), line, AMBIGUOUS, f"defined more than once: {', '.join(both)}")
    if keys is None:
        return Metric(name, raw, None, "", line, NOT_EXTRACTABLE, "a grouping key is no literal")
    full = Printer(scope)
    text = full.text(formula)
    free = sorted(set(full.free) - full.called - {"F"})
    return Metric(name, raw, text, ",".join(keys), line, PARTIAL if free else EXTRACTED, f"without a value: {', '.join(free)}" if free else "")


def metrics_of(code: str) -> list[Metric]:
    """Named aggregations of the functions of a source file; a file that cannot be read is one row of its own."""
    try:
        tree = ast.parse(code)
    except (SyntaxError, ValueError, RecursionError) as e:
        return [Metric("", "", None, "", 0, NOT_EXTRACTABLE, f"cannot be parsed: {type(e).__name__}")]
    constants = {t.id: n.value for n in tree.body if isinstance(n, ast.Assign) and isinstance(n.value, ast.Constant) for t in n.targets if isinstance(t, ast.Name)}
    found = []
    for function in (n for n in ast.walk(tree) if isinstance(n, ast.FunctionDef)):
        scope = scope_of(function, constants)
        for agg in (n for n in ast.walk(function) if _is(n, "agg")):
            keys = grain_of(agg)
            found += [metric_of(name, arg.func.value, keys, scope) for arg in agg.args if _is(arg, "alias") and arg.args and (name := _literal(arg.args[0]))]
    return found


def formula_hash(canonical: str | None) -> str | None:
    return None if canonical is None else hashlib.sha256(canonical.encode()).hexdigest()


def declared_hash(formula: str) -> str | None:
    """Hash of a declared formula, as the same formula in a source has it; null if it cannot be read."""
    try:
        return formula_hash(Printer(Scope({}, {}, set())).text(ast.parse(formula.strip(), mode="eval").body))
    except (SyntaxError, ValueError, RecursionError):
        return None
