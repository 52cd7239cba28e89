"""The expression language of filters, cases, computed columns and contracts.

Python syntax with a whitelist of node types, turned into Columns. ``& | ~`` bind
like ``and or not``; names in backticks may hold any characters. ``[f(x) for x in xs if c]``,
``any(...)`` and ``all(...)`` of such a loop, ``len(xs)``, ``xs[0]``, ``m['key']`` and ``json(text, '$.a', 'long')`` work on
arrays, maps, structs and JSON texts. Nothing is
evaluated as code, and no text reaches Spark's own parser.
"""

from __future__ import annotations

import ast
import io
import tokenize
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from .coerce import java_pattern, lit


class ExpressionError(ValueError):
    """The text is not an expression of this language, or names an unknown column."""


_LOGICAL = {"&": "and", "|": "or", "~": "not"}
_FUNCTIONS = {"abs": F.abs, "sqrt": F.sqrt, "exp": F.exp, "log": F.log, "log10": F.log10, "sin": F.sin, "cos": F.cos, "floor": F.floor, "ceil": F.ceil}


def _prepare(text: str) -> tuple[str, dict[str, str]]:
    """Backtick names to placeholders, and the symbols of logic to words."""
    names: dict[str, str] = {}
    parts = text.split("`")
    if len(parts) % 2 == 0:
        raise ExpressionError(f"unbalanced backticks: {text}")
    for i in range(1, len(parts), 2):
        names[f"__quoted_{i}"] = parts[i]
        parts[i] = f" __quoted_{i} "
    try:
        tokens = [
            (t.type if t.string not in _LOGICAL or t.type != tokenize.OP else tokenize.NAME, _LOGICAL.get(t.string, t.string) if t.type == tokenize.OP else t.string)
            for t in tokenize.generate_tokens(io.StringIO("".join(parts).strip()).readline)
        ]
        return tokenize.untokenize(tokens).strip(), names
    except (tokenize.TokenError, SyntaxError) as e:
        raise ExpressionError(f"cannot read: {text}") from e


def _tree(text: str) -> tuple[ast.expr, dict[str, str]]:
    source, names = _prepare(text)
    try:
        return ast.parse(source, mode="eval").body, names
    except SyntaxError as e:
        raise ExpressionError(f"cannot read: {text}") from e


def identifiers(text: str) -> set[str]:
    """The column names that an expression uses."""
    tree, names = _tree(text)
    calls = {id(n.func) for n in ast.walk(tree) if isinstance(n, ast.Call)}
    bound = {g.target.id for n in ast.walk(tree) for g in getattr(n, "generators", ()) if isinstance(g.target, ast.Name)}
    return {names.get(n.id, n.id) for n in ast.walk(tree) if isinstance(n, ast.Name) and id(n) not in calls and n.id not in bound}


class _Builder:
    def __init__(self, columns: Mapping[str, Column], names: dict[str, str], null_mode: str):
        self.columns, self.names, self.numpy = columns, names, null_mode == "numpy"

    def build(self, n: ast.expr) -> Column:
        method = getattr(self, f"_{type(n).__name__.lower()}", None)
        if method is None:
            raise ExpressionError(f"{type(n).__name__} is not allowed")
        return method(n)

    def _name(self, n: ast.Name) -> Column:
        name = self.names.get(n.id, n.id)
        if name not in self.columns:
            raise ExpressionError(f"unknown column {name}")
        return self.columns[name]

    def _constant(self, n: ast.Constant) -> Column:
        if not isinstance(n.value, (bool, int, float, str, type(None))):
            raise ExpressionError(f"{n.value!r} is not allowed")
        return lit(n.value)

    def _boolop(self, n: ast.BoolOp) -> Column:
        parts = [self.build(v) for v in n.values]
        out = parts[0]
        for p in parts[1:]:
            out = out & p if isinstance(n.op, ast.And) else out | p
        return out

    def _unaryop(self, n: ast.UnaryOp) -> Column:
        v = self.build(n.operand)
        if isinstance(n.op, ast.Not):
            return ~v
        if isinstance(n.op, ast.USub):
            return -v
        if isinstance(n.op, ast.UAdd):
            return v
        raise ExpressionError("this operator is not allowed")

    def _binop(self, n: ast.BinOp) -> Column:
        a, b = self.build(n.left), self.build(n.right)
        d = lambda c: c.cast("double")
        match n.op:
            case ast.Add():
                return a + b
            case ast.Sub():
                return a - b
            case ast.Mult():
                return a * b
            case ast.Div():  # by zero: null
                return F.try_divide(d(a), d(b))
            case ast.FloorDiv():
                return F.floor(F.try_divide(d(a), d(b)))
            case ast.Mod():  # the sign of the divisor, as in Python
                return d(a) - d(b) * F.floor(F.try_divide(d(a), d(b)))
            case ast.Pow():
                return F.pow(d(a), d(b))
        raise ExpressionError("this operator is not allowed")

    def _compare(self, n: ast.Compare) -> Column:
        out, left = None, n.left
        for op, right in zip(n.ops, n.comparators, strict=True):
            one = self._one(left, op, right)
            out, left = one if out is None else out & one, right
        return out

    def _one(self, left: ast.expr, op: ast.cmpop, right: ast.expr) -> Column:
        a = self.build(left)
        if isinstance(op, (ast.In, ast.NotIn)):
            if not isinstance(right, (ast.List, ast.Tuple, ast.Set)):
                raise ExpressionError("in takes a list")
            found = a.isin(*(self.build(e) for e in right.elts)) if right.elts else F.lit(False)
            out, negative = (found, False) if isinstance(op, ast.In) else (~found, True)
        else:
            b = self.build(right)
            table = {ast.Eq: a == b, ast.NotEq: a != b, ast.Lt: a < b, ast.LtE: a <= b, ast.Gt: a > b, ast.GtE: a >= b}
            if type(op) not in table:
                raise ExpressionError("this comparison is not allowed")
            out, negative = table[type(op)], isinstance(op, ast.NotEq)
        return F.coalesce(out, F.lit(negative)) if self.numpy else out

    def _loop(self, n: ast.ListComp | ast.GeneratorExp) -> tuple[Column, str]:
        """The array that a loop runs over, after its conditions, and the name of its variable."""
        if len(n.generators) != 1 or not isinstance(n.generators[0].target, ast.Name) or n.generators[0].is_async:
            raise ExpressionError("a loop has one variable and one array")
        g = n.generators[0]
        out = self.build(g.iter)
        for c in g.ifs:
            out = F.filter(out, self._body(g.target.id, c))
        return out, g.target.id

    def _body(self, name: str, body: ast.expr):
        return lambda x: _Builder({**self.columns, name: x}, self.names, "numpy" if self.numpy else "sql").build(body)

    def _listcomp(self, n: ast.ListComp) -> Column:
        array, name = self._loop(n)
        return F.transform(array, self._body(name, n.elt))

    def _subscript(self, n: ast.Subscript) -> Column:
        key = n.slice
        if isinstance(key, ast.UnaryOp) and isinstance(key.op, ast.USub) and isinstance(key.operand, ast.Constant):
            key = ast.Constant(-key.operand.value)
        if not isinstance(key, ast.Constant) or isinstance(key.value, bool) or not isinstance(key.value, (int, str)):
            raise ExpressionError("an index is a whole number or a text")
        c = self.build(n.value)
        if isinstance(key.value, str):
            return c.getItem(key.value)
        return F.get(c, F.lit(key.value)) if key.value >= 0 else F.try_element_at(c, F.lit(key.value))

    def _json(self, args: list[ast.expr]) -> Column:
        texts = [a.value for a in args[1:] if isinstance(a, ast.Constant) and isinstance(a.value, str)]
        if len(args) not in (2, 3) or len(texts) != len(args) - 1:
            raise ExpressionError("json takes a column, a path and a type")
        return F.try_variant_get(F.try_parse_json(self.build(args[0])), texts[0], texts[1] if len(texts) == 2 else "string")

    def _call(self, n: ast.Call) -> Column:
        if n.keywords:
            raise ExpressionError("named arguments are not allowed")
        if isinstance(n.func, ast.Name) and n.func.id in ("any", "all") and len(n.args) == 1 and isinstance(n.args[0], (ast.GeneratorExp, ast.ListComp)):
            array, name = self._loop(n.args[0])
            return (F.exists if n.func.id == "any" else F.forall)(array, self._body(name, n.args[0].elt))
        if isinstance(n.func, ast.Name) and n.func.id == "len" and len(n.args) == 1:
            return F.size(self.build(n.args[0]))
        if isinstance(n.func, ast.Name) and n.func.id == "json":
            return self._json(n.args)
        if isinstance(n.func, ast.Name) and n.func.id in _FUNCTIONS and len(n.args) == 1:
            return _FUNCTIONS[n.func.id](self.build(n.args[0]))
        if isinstance(n.func, ast.Attribute):
            owner, name = n.func.value, n.func.attr
            if name in ("isnull", "isna", "notnull", "notna") and not n.args:
                c = self.build(owner)
                return c.isNull() if name.startswith("is") else c.isNotNull()
            if isinstance(owner, ast.Attribute) and owner.attr == "str":
                return self._text(self.build(owner.value), name, n.args)
        raise ExpressionError("this call is not allowed")

    def _text(self, c: Column, name: str, args: list[ast.expr]) -> Column:
        if not args and name in ("lower", "upper", "len"):
            return {"lower": F.lower, "upper": F.upper, "len": F.length}[name](c)
        if len(args) == 1 and isinstance(args[0], ast.Constant) and isinstance(args[0].value, str):
            v = args[0].value
            if name == "contains":
                return c.rlike(java_pattern(v))
            if name in ("startswith", "endswith"):
                return getattr(c, name)(v)
        raise ExpressionError(f"str.{name} is not allowed here")


def parse(text: str, columns: Mapping[str, Column], null_mode: str = "sql") -> Column:
    """The Column of an expression over ``columns``.

    ``null_mode`` "sql": three-valued logic. "numpy": a comparison with null is
    false, and ``!=`` and ``not in`` are true.
    """
    if not isinstance(text, str) or not text.strip():
        raise ExpressionError("an empty expression")
    tree, names = _tree(text)
    return _Builder(columns, names, null_mode).build(tree)
