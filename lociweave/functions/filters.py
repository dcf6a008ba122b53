"""Filter expressions over records, such as ``DP >= 20 && (FILTER == "PASS" || !exists(DB))``, as column expressions.

From what binds closest: ``( )``, numbers, "strings", column names and functions; unary ``+ - ! ~``; ``* / %``; ``+ -``; ``&``; ``^``; ``|``;
``< <= > >=``; ``== != =~ !~``; ``&& ||``, which bind alike and from the left. Comparisons bind from the right. Functions: avg, min, max,
length, exists, default, exp, log, pow, sqrt.

A value is a number, a text or a list of numbers, by the column's type (truth values are 0 and 1), or undefined: a null, not a number.
Arithmetic, bits, comparisons and functions of something undefined are undefined, and so is ``&&`` with anything undefined, and ``||``
unless the other side is true. ``!`` of something undefined is true. A text is true, the empty one too; a number is true unless it is 0. A
text equals no number and isn't ordered against one; arithmetic, patterns and functions on the wrong type are errors when the expression
is read. Bits and remainders are those of whole parts, a remainder has its dividend's sign and is undefined by 0; division by 0 is
infinite. min, max and avg leave out a list's missing values; of an empty list min and max are undefined and avg is 0. Lists take part in
functions only. In strings \\" \\\\ \\t \\n \\r are escapes, any other backslash stays, so that "DP=\\d" is a pattern.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TOKEN = re.compile(r"""\s*(?:(?P<number>(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)|"(?P<text>(?:[^"\\]|\\.)*)"|(?P<call>[A-Za-z]+)\(|(?P<name>[A-Za-z_][\w.]*)|(?P<sign>&&|\|\||==|!=|=~|!~|<=|>=|[-+*/%&^|<>!~(),]))""", re.S)
_ESCAPES = {'"': '"', "\\": "\\", "t": "\t", "n": "\n", "r": "\r"}
NUMBER, TEXT, LIST = "number", "text", "list"
#: Binary operators by level, loosest first; levels that group from the right.
LEVELS = [("&&", "||"), ("==", "!=", "=~", "!~"), ("<", "<=", ">", ">="), ("|",), ("^",), ("&",), ("+", "-"), ("*", "/", "%")]
FROM_THE_RIGHT = (1, 2)


@dataclass
class Value:
    """A column, null where undefined, and what it holds."""

    column: Column
    kind: str


def _number(column: Column) -> Value:
    return Value(F.when(~F.isnan(column), column), NUMBER)


def _flag(condition: Column) -> Value:
    """1 or 0, undefined where the condition is null."""
    return Value(condition.cast("int").cast("double"), NUMBER)


def truth(value: Value) -> Column:
    """Whether a value is true; null where it is undefined."""
    if value.kind == NUMBER:
        return value.column != 0
    return F.when(value.column.isNotNull(), True)


def _whole(value: Value) -> Column:
    return value.column.cast("long")


def _divided(a: Column, b: Column) -> Column:
    infinite = F.when(a > 0, float("inf")).when(a < 0, float("-inf"))
    return F.when(b == 0, infinite).otherwise(F.try_divide(a, b))


_ARITHMETIC: dict[str, Callable[[Value, Value], Column]] = {
    "+": lambda a, b: a.column + b.column,
    "-": lambda a, b: a.column - b.column,
    "*": lambda a, b: a.column * b.column,
    "/": lambda a, b: _divided(a.column, b.column),
    "%": lambda a, b: F.when(_whole(b) != 0, F.try_mod(_whole(a), _whole(b))).cast("double"),
    "&": lambda a, b: _whole(a).bitwiseAND(_whole(b)).cast("double"),
    "^": lambda a, b: _whole(a).bitwiseXOR(_whole(b)).cast("double"),
    "|": lambda a, b: _whole(a).bitwiseOR(_whole(b)).cast("double"),
}
_COMPARED: dict[str, Callable[[Column, Column], Column]] = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "==": lambda a, b: a == b, "!=": lambda a, b: a != b}


class FilterError(ValueError):
    """An expression that can't be read, or that puts a value where its type doesn't fit."""


def _need(value: Value, kind: str, where: str) -> Value:
    if value.kind != kind:
        raise FilterError(f"{where} needs a {kind}, not a {value.kind}")
    return value


def _binary(sign: str, a: Value, b: Value) -> Value:
    if sign in _ARITHMETIC:
        return _number(_ARITHMETIC[sign](_need(a, NUMBER, sign), _need(b, NUMBER, sign)))
    if LIST in (a.kind, b.kind):
        raise FilterError(f"{sign} doesn't take lists")
    if sign in ("=~", "!~"):
        found = F.rlike(_need(a, TEXT, sign).column, _need(b, TEXT, sign).column)
        return _flag(found if sign == "=~" else ~found)
    both = a.column.isNotNull() & b.column.isNotNull()
    if sign in ("&&", "||"):
        x, y = truth(a), truth(b)
        return _flag(F.when(both, x & y) if sign == "&&" else x | y)
    if a.kind == b.kind:
        return _flag(_COMPARED[sign](a.column, b.column))
    return _flag(F.when(both, F.lit(sign == "!=")))


def _unary(sign: str, value: Value) -> Value:
    if sign == "!":
        return Value(F.when(F.coalesce(truth(value), F.lit(False)), 0.0).otherwise(1.0), NUMBER)
    _need(value, NUMBER, sign)
    return _number({"+": value.column, "-": -value.column, "~": F.bitwise_not(_whole(value)).cast("double")}[sign])


def _called(name: str, args: list[Value]) -> Value:
    """A function of its arguments."""
    n = 2 if name in ("default", "pow") else 1
    if len(args) != n:
        raise FilterError(f"{name} takes {n}")
    x = args[0]
    if name == "exists":
        return _flag(x.column.isNotNull())
    if name == "default":
        if args[1].kind != x.kind:
            raise FilterError("default needs two values of one type")
        return Value(F.coalesce(x.column, args[1].column), x.kind)
    if name == "length":
        if x.kind == NUMBER:
            raise FilterError("length needs a text or a list")
        return Value((F.size(x.column) if x.kind == LIST else F.length(x.column)).cast("double"), NUMBER)
    if name in ("min", "max", "avg"):
        held = F.filter(_need(x, LIST, name).column, lambda v: v.isNotNull() & ~F.isnan(v))
        total = F.aggregate(held, F.lit(0.0), lambda s, v: s + v)
        mean = F.when(F.size(held) == 0, 0.0).otherwise(F.try_divide(total, F.size(held)))
        return Value({"min": F.array_min(held), "max": F.array_max(held), "avg": F.when(x.column.isNotNull(), mean)}[name], NUMBER)
    for a in args:
        _need(a, NUMBER, name)
    c = x.column
    if name == "log":
        return _number(F.when(c == 0, float("-inf")).otherwise(F.ln(c)))
    return _number({"exp": lambda: F.exp(c), "sqrt": lambda: F.sqrt(c), "pow": lambda: F.pow(c, args[1].column)}[name]())


FUNCTIONS = ("avg", "default", "exists", "exp", "length", "log", "max", "min", "pow", "sqrt")


def _tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while text[at:].strip():
        m = _TOKEN.match(text, at)
        if not m:
            raise FilterError(f"can't read the expression at {text[at:]!r}")
        kind = m.lastgroup
        out.append((kind, re.sub(r"\\(.)", lambda e: _ESCAPES.get(e[1], e[0]), m["text"], flags=re.S) if kind == "text" else m[kind]))
        at = m.end()
    return out


class _Reader:
    def __init__(self, text: str, columns: T.StructType):
        self.tokens, self.at = _tokens(text), 0
        self.columns = {f.name: f.dataType for f in columns}

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "the end")

    def take(self, sign: str) -> bool:
        found = self.peek() == ("sign", sign)
        self.at += found
        return found

    def expect(self, sign: str) -> None:
        if not self.take(sign):
            raise FilterError(f"{sign} is missing before {self.peek()[1]}")

    def binary(self, level: int = 0) -> Value:
        if level == len(LEVELS):
            return self.unary()
        value = self.binary(level + 1)
        while (token := self.peek())[0] == "sign" and token[1] in LEVELS[level]:
            self.at += 1
            right = level in FROM_THE_RIGHT
            value = _binary(token[1], value, self.binary(level if right else level + 1))
        return value

    def unary(self) -> Value:
        for sign in ("!", "~"):
            if self.take(sign):
                return _unary(sign, self.unary())
        for sign in ("+", "-"):
            if self.take(sign):
                return _unary(sign, self.simple())
        return self.simple()

    def simple(self) -> Value:
        kind, text = self.peek()
        self.at += 1
        if kind == "number":
            return Value(F.lit(float(text)), NUMBER)
        if kind == "text":
            return Value(F.lit(text), TEXT)
        if kind == "name":
            return self.named(text)
        if kind == "call":
            if text not in FUNCTIONS:
                raise FilterError(f"no function {text}")
            args = [self.binary()]
            while self.take(","):
                args.append(self.binary())
            self.expect(")")
            return _called(text, args)
        if (kind, text) == ("sign", "("):
            value = self.binary()
            self.expect(")")
            return value
        raise FilterError(f"a value is missing before {text}")

    def named(self, name: str) -> Value:
        if name not in self.columns:
            raise FilterError(f"no column {name}")
        column, kind = F.col(f"`{name}`"), self.columns[name]
        if isinstance(kind, T.BooleanType):
            return _flag(column)
        if isinstance(kind, T.NumericType):
            return _number(column.cast("double"))
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.NumericType):
            return Value(column.cast("array<double>"), LIST)
        if isinstance(kind, T.StringType):
            return Value(column, TEXT)
        raise FilterError(f"column {name} is of type {kind.simpleString()}")


def value(text: str, columns: DataFrame | T.StructType) -> Column:
    """What an expression over ``columns`` gives: a double, a string or an array of doubles; null where undefined."""
    return _read(text, columns).column


def _read(text: str, columns: DataFrame | T.StructType) -> Value:
    reader = _Reader(text, columns.schema if isinstance(columns, DataFrame) else columns)
    found = reader.binary()
    if reader.peek()[0] != "end":
        raise FilterError(f"can't read {reader.peek()[1]!r}")
    return found


def condition(text: str, columns: DataFrame | T.StructType) -> Column:
    """Whether an expression over ``columns`` is true; something undefined isn't."""
    return F.coalesce(truth(_read(text, columns)), F.lit(False))


def filtered(rows: DataFrame, text: str) -> DataFrame:
    """The rows for which an expression is true."""
    return rows.where(condition(text, rows))
