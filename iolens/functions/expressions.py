"""User expressions as Columns: a whitelist compiler, without eval.

Known: numbers, names, + - * / // % **, comparisons (also chained), and or not,
& | ~, max, min, abs, clip01, fillna0, isna and the functions and constants of
`math`. Division by 0 gives null. max and min ignore nulls; with one argument
they are that argument (rowwise) or the column's extreme over the view (column).
"""

from __future__ import annotations

import ast
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

MATH: dict[str, Callable[..., Column]] = {
    "sqrt": F.sqrt, "exp": F.exp, "log": F.log, "log2": F.log2, "log10": F.log10, "log1p": F.log1p, "atan": F.atan, "sin": F.sin, "cos": F.cos, "tan": F.tan,
    "floor": F.floor, "ceil": F.ceil, "degrees": F.degrees, "radians": F.radians, "fabs": F.abs, "pow": F.pow,
}
CONSTANTS = {"pi": 3.141592653589793, "e": 2.718281828459045}


class ExpressionError(ValueError):
    """The expression holds something outside the whitelist, or an unknown name."""


def identifiers(text: str) -> list[str]:
    """Names an expression uses, without functions, in order of appearance."""
    tree = ast.parse(text.strip(), mode="eval")
    called = {id(n.func) for n in ast.walk(tree) if isinstance(n, ast.Call)}
    base = {id(n.value) for n in ast.walk(tree) if isinstance(n, ast.Attribute)}
    names = [n for n in ast.walk(tree) if isinstance(n, ast.Name) and id(n) not in called | base]
    return list(dict.fromkeys(n.id for n in sorted(names, key=lambda n: (n.lineno, n.col_offset)) if n.id not in ("True", "False", "None")))


def denominators(text: str) -> list[str]:
    """Names under the first division."""
    for n in ast.walk(ast.parse(text.strip(), mode="eval")):
        if isinstance(n, ast.BinOp) and isinstance(n.op, ast.Div):
            return identifiers(ast.unparse(n.right))
    return []


def mixes_time_aggregates(text: str) -> bool:
    """Whether sums and maxima of time meet in one expression."""
    names = identifiers(text)
    return any(n.endswith("_time_sum") for n in names) and any(n.endswith(("_time_max", "_time_proc_max")) for n in names)


def compile_expression(text: str, names: set[str], aggregates: str = "rowwise", column_value: Callable[[str, Column], Column] | None = None) -> Column:
    """The Column of an expression over the columns `names`.

    aggregates="column": column_value(how, argument) gives the extreme of a
    one-argument max or min.
    """
    try:
        tree = ast.parse(text.strip(), mode="eval")
    except SyntaxError as e:
        raise ExpressionError(f"not an expression: {text!r}") from e
    return _Compiler(names, aggregates, column_value).visit(tree.body)


class _Compiler(ast.NodeVisitor):
    def __init__(self, names: set[str], aggregates: str, column_value):
        self.names, self.aggregates, self.column_value = names, aggregates, column_value

    def generic_visit(self, node: ast.AST) -> Column:
        raise ExpressionError(f"{type(node).__name__} isn't allowed in an expression")

    def visit_Constant(self, node: ast.Constant) -> Column:
        if node.value is not None and not isinstance(node.value, (int, float, str, bool)):
            raise ExpressionError(f"constant {node.value!r} isn't allowed")
        return F.lit(float(node.value) if isinstance(node.value, int) and not isinstance(node.value, bool) else node.value)

    def visit_Name(self, node: ast.Name) -> Column:
        if node.id not in self.names:
            raise ExpressionError(f"unknown name {node.id}")
        return F.col(f"`{node.id}`")

    def visit_Attribute(self, node: ast.Attribute) -> Column:
        if isinstance(node.value, ast.Name) and node.value.id == "math" and node.attr in CONSTANTS:
            return F.lit(CONSTANTS[node.attr])
        raise ExpressionError("attributes aren't allowed, but for math")

    def visit_UnaryOp(self, node: ast.UnaryOp) -> Column:
        v = self.visit(node.operand)
        if isinstance(node.op, (ast.Not, ast.Invert)):
            return ~v
        return -v if isinstance(node.op, ast.USub) else v

    def visit_BinOp(self, node: ast.BinOp) -> Column:
        a, b = self.visit(node.left), self.visit(node.right)
        match node.op:
            case ast.Add():
                return a + b
            case ast.Sub():
                return a - b
            case ast.Mult():
                return a * b
            case ast.Div():
                return F.try_divide(a, b)
            case ast.FloorDiv():
                return F.floor(F.try_divide(a, b))
            case ast.Mod():
                return F.when(b != 0, F.pmod(a, b))
            case ast.Pow():
                return F.pow(a, b)
            case ast.BitAnd():
                return a & b
            case ast.BitOr():
                return a | b
        raise ExpressionError(f"operator {type(node.op).__name__} isn't allowed")

    def visit_BoolOp(self, node: ast.BoolOp) -> Column:
        parts = [self.visit(v) for v in node.values]
        out = parts[0]
        for p in parts[1:]:
            out = out & p if isinstance(node.op, ast.And) else out | p
        return out

    def visit_Compare(self, node: ast.Compare) -> Column:
        sides = [self.visit(v) for v in [node.left, *node.comparators]]
        out = None
        for a, op, b in zip(sides, node.ops, sides[1:], strict=False):
            match op:
                case ast.Lt():
                    c = a < b
                case ast.LtE():
                    c = a <= b
                case ast.Gt():
                    c = a > b
                case ast.GtE():
                    c = a >= b
                case ast.Eq():
                    c = a == b
                case ast.NotEq():
                    c = a != b
                case _:
                    raise ExpressionError(f"comparison {type(op).__name__} isn't allowed")
            out = c if out is None else out & c
        return out

    def visit_IfExp(self, node: ast.IfExp) -> Column:
        return F.when(self.visit(node.test), self.visit(node.body)).otherwise(self.visit(node.orelse))

    def visit_Call(self, node: ast.Call) -> Column:
        if node.keywords:
            raise ExpressionError("keyword arguments aren't allowed")
        args = [self.visit(a) for a in node.args]
        f = node.func
        if isinstance(f, ast.Attribute) and isinstance(f.value, ast.Name) and f.value.id == "math" and f.attr in MATH:
            return MATH[f.attr](*args)
        if not isinstance(f, ast.Name) or not args:
            raise ExpressionError("only known functions can be called")
        if f.id in ("max", "min"):
            if len(args) > 1:
                return (F.greatest if f.id == "max" else F.least)(*args)
            return self.column_value(f.id, args[0]) if self.aggregates == "column" and self.column_value else args[0]
        if f.id == "abs":
            return F.abs(args[0])
        if f.id == "clip01":
            return F.when(args[0].isNotNull(), F.least(F.greatest(args[0], F.lit(0.0)), F.lit(1.0)))
        if f.id == "fillna0":
            return F.coalesce(args[0], F.lit(0.0))
        if f.id == "isna":
            return args[0].isNull()
        raise ExpressionError(f"unknown function {f.id}")


def additional_metrics(view, formulas: dict[str, str], values: dict[str, str] | None = None):
    """Adds formulas over a view; null where all names under the first division are null or 0.

    {epsilon}, {time_interval} and {time_metric} in a formula are filled from `values`.
    """
    for name, text in formulas.items():
        text = text.format(**({"epsilon": "1e-9"} | (values or {})))
        under = [d for d in denominators(text) if d in view.columns]
        c = compile_expression(text, set(view.columns))
        if under:
            empty = None
            for d in under:
                e = F.coalesce(F.col(d) == 0, F.lit(True))
                empty = e if empty is None else empty & e
            c = F.when(~empty, c)
        view = view.withColumn(name, c)
    return view
