"""Expressions from text: C-like integer expressions as columns, and derivatives of formulas."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"\s*(?:(0[xX][0-9a-fA-F]+|\d+\.\d*|\d+)|([A-Za-z_]\w*)|(<=>|<<|>>|<=|>=|==|!=|&&|\|\||[-+*/%&|^~!<>?:(),.\[\]]))")
#: Binary operators from the weakest to the strongest, as in C.
_LEVELS = (("||",), ("&&",), ("|",), ("^",), ("&",), ("==", "!=", "<=>"), ("<", "<=", ">", ">="), ("<<", ">>"), ("+", "-"), ("*", "/", "%"))


@dataclass(frozen=True)
class Node:
    """A node of a parsed expression."""

    op: str
    args: tuple = ()
    value: object = None


def parse(text: str) -> Node:
    """The tree of a C-like expression of numbers, names and + - ~ ! * / % << >> < <= > >= == != <=> & ^ | && || ?: (), fields a.b, indexes a[i] from 0 and calls f(a, b)."""
    tokens, at = [], 0
    text = text.strip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"cannot read {text[at:]!r}")
        tokens.append(m.groups())
        at = m.end()
    place = 0

    def peek() -> str | None:
        return tokens[place][2] if place < len(tokens) else None

    def take(op: str) -> None:
        nonlocal place
        if peek() != op:
            raise ValueError(f"{op} is missing")
        place += 1

    def unary() -> Node:
        nonlocal place
        if place >= len(tokens):
            raise ValueError("an operand is missing")
        number, name, op = tokens[place]
        place += 1
        if number:
            return Node("number", value=float(number) if "." in number else int(number, 0) if number[:2].lower() == "0x" else int(number))
        if name and peek() == "(":
            return after(Node("call", tuple(listed(")")), name))
        if name:
            return after(Node("name", value=name))
        if op == "(":
            inner = choice()
            take(")")
            return after(inner)
        if op in ("+", "-", "~", "!"):
            return Node("u" + op, (unary(),))
        raise ValueError(f"{op} where an operand should be")

    def listed(close: str) -> list[Node]:
        """Arguments up to a closing bracket."""
        nonlocal place
        place += 1
        out = []
        while peek() != close:
            out.append(choice())
            if peek() != close:
                take(",")
        take(close)
        return out

    def after(n: Node) -> Node:
        """Fields and indexes that follow."""
        nonlocal place
        while peek() in (".", "["):
            if peek() == ".":
                place += 1
                if place >= len(tokens) or not tokens[place][1]:
                    raise ValueError("a field's name is missing")
                n = Node("field", (n,), tokens[place][1])
                place += 1
            else:
                (at,) = listed("]")
                n = Node("index", (n, at))
        return n

    def binary(level: int) -> Node:
        nonlocal place
        if level == len(_LEVELS):
            return unary()
        left = binary(level + 1)
        while peek() in _LEVELS[level]:
            op = peek()
            place += 1
            left = Node(op, (left, binary(level + 1)))
        return left

    def choice() -> Node:
        nonlocal place
        test = binary(0)
        if peek() != "?":
            return test
        place += 1
        yes = choice()
        take(":")
        return Node("?:", (test, yes, choice()))

    out = choice()
    if place != len(tokens):
        raise ValueError("text is left over")
    return out


#: Functions that an expression may call.
CALLS = {
    "abs": F.abs, "min": F.least, "max": F.greatest, "sqrt": F.sqrt, "exp": F.exp, "log": F.log, "sin": F.sin, "cos": F.cos, "tan": F.tan, "floor": F.floor, "ceil": F.ceil,
    "pow": F.pow, "length": F.length, "size": F.size, "select": lambda test, yes, no: F.when(_truth(test), yes).otherwise(no),
}


def _truth(c: Column) -> Column:
    return F.coalesce(c != 0, F.lit(False))


def _number(c: Column) -> Column:
    return F.when(c, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))


def to_column(n: Node, names: dict[str, Column] | None = None) -> Column:
    """A column of a tree; conditions are 1 or 0, division of whole numbers truncates, division by 0 is null."""
    go = lambda x: to_column(x, names)
    if n.op == "number":
        return F.lit(n.value).cast("double" if isinstance(n.value, float) else "long")
    if n.op == "name":
        return (names or {}).get(n.value, F.col(n.value))
    if n.op == "field":
        return go(n.args[0]).getField(n.value)
    a = [go(x) for x in n.args]
    if n.op == "index":
        return F.get(a[0], a[1].cast("int"))
    if n.op == "call":
        return CALLS[n.value](*a)
    if n.op == "?:":
        return F.when(_truth(a[0]), a[1]).otherwise(a[2])
    if n.op == "&&":
        return _number(_truth(a[0]) & _truth(a[1]))
    if n.op == "||":
        return _number(_truth(a[0]) | _truth(a[1]))
    if n.op.startswith("u"):
        return {"u+": lambda: a[0], "u-": lambda: -a[0], "u~": lambda: F.bitwise_not(a[0].cast("long")), "u!": lambda: _number(~_truth(a[0]))}[n.op]()
    x, y = a
    whole = lambda: F.try_divide(x.cast("long") - F.try_mod(x.cast("long"), y.cast("long")), y.cast("long")).cast("long")
    made = {
        "+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "/": whole, "%": lambda: F.try_mod(x, y),
        "<<": lambda: F.call_function("shiftleft", x.cast("long"), y.cast("int")), ">>": lambda: F.call_function("shiftright", x.cast("long"), y.cast("int")),
        "&": lambda: x.cast("long").bitwiseAND(y.cast("long")), "|": lambda: x.cast("long").bitwiseOR(y.cast("long")), "^": lambda: x.cast("long").bitwiseXOR(y.cast("long")),
        "<": lambda: _number(x < y), "<=": lambda: _number(x <= y), ">": lambda: _number(x > y), ">=": lambda: _number(x >= y), "==": lambda: _number(x == y), "!=": lambda: _number(x != y),
        "<=>": lambda: F.when(x < y, F.lit(-1).cast("long")).when(x > y, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long")),
    }
    return made[n.op]()


def evaluate(text: str, names: dict[str, Column] | None = None) -> Column:
    """A C-like expression as a column; Catalyst folds its constants and prunes its branches."""
    return to_column(parse(text), names)


def derivative(n: Node, by: str) -> Node:
    """Derivative of a tree of + - * / and negation."""
    num = lambda v: Node("number", value=v)
    if n.op == "number":
        return num(0)
    if n.op == "name":
        return num(1 if n.value == by else 0)
    d = [derivative(x, by) for x in n.args]
    if n.op in ("+", "-"):
        return Node(n.op, tuple(d))
    if n.op in ("u-", "u+"):
        return Node(n.op, (d[0],))
    if n.op == "*":
        return Node("+", (Node("*", (d[0], n.args[1])), Node("*", (n.args[0], d[1]))))
    if n.op == "/":
        return Node("/", (Node("-", (Node("*", (d[0], n.args[1])), Node("*", (n.args[0], d[1])))), Node("*", (n.args[1], n.args[1]))))
    raise ValueError(f"no derivative of {n.op}")


def real_column(n: Node, names: dict[str, Column] | None = None) -> Column:
    """Like to_column for + - * / and negation, in real numbers."""
    if n.op == "number":
        return F.lit(float(n.value))
    if n.op == "name":
        return (names or {}).get(n.value, F.col(n.value)).cast("double")
    a = [real_column(x, names) for x in n.args]
    return {"u-": lambda: -a[0], "u+": lambda: a[0], "+": lambda: a[0] + a[1], "-": lambda: a[0] - a[1], "*": lambda: a[0] * a[1], "/": lambda: F.try_divide(a[0], a[1])}[n.op]()
