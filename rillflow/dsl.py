"""The filter language: text -> tree -> Spark column. AND binds tighter than OR; keywords ignore case."""

from __future__ import annotations

import ipaddress
import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from .functions import flow as fn
from .schema import COUNTERS, FILTER_FIELDS

TOKEN = re.compile(
    r"""\s+|//[^\n]*|/\*.*?\*/
    |(?P<string>'[^']*')
    |(?P<mac>(?:[0-9a-f]{2}:){5}[0-9a-f]{2}\b)
    |(?P<addr>\d+\.\d+\.\d+\.\d+(?:/\d+)?|[0-9a-f]*:[0-9a-f:.]+(?:/\d+)?)
    |(?P<range>(?:0x[0-9a-f]+|\d+)(?:\s*-\s*(?:0x[0-9a-f]+|\d+))?)
    |(?P<word>[a-z_][\w-]*)
    |(?P<sign>[(),])""",
    re.I | re.S | re.X,
)
GEO = ("continent", "country_code", "country", "state", "city", "zip", "lat", "long")
LOOKUPS = {*GEO, "asn", "asd"}
FUNCTIONS = {"div", "div_r", "div_l", "divr", "divl", "min", "mfreq", "tfstr", "portstr", "ppstr"} | LOOKUPS
KEYWORDS = {"and", "or", "not", "src", "dst", "asc", "desc"}


class FilterError(ValueError):
    pass


@dataclass
class Rule:
    """field or function, direction, arguments of the function, values."""

    name: str
    direction: str | None = None
    args: list = field(default_factory=list)
    values: list[tuple[str, str]] = field(default_factory=list)


@dataclass
class Node:
    """op: and, or, not."""

    op: str
    parts: list


def tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            raise FilterError(f"unexpected {text[at : at + 12]!r}")
        at = m.end()
        if m.lastgroup:
            value = m[m.lastgroup]
            out.append((m.lastgroup, value[1:-1] if m.lastgroup == "string" else value if m.lastgroup == "word" and value.lower() not in KEYWORDS | FUNCTIONS | set(FILTER_FIELDS) else value.lower()))
    return out


class _Parser:
    def __init__(self, text: str):
        self.all, self.at = tokens(text), 0

    def peek(self, ahead: int = 0) -> tuple[str, str]:
        return self.all[self.at + ahead] if self.at + ahead < len(self.all) else ("end", "")

    def next(self, want: str | None = None) -> tuple[str, str]:
        got = self.peek()
        if want is not None and got[1] != want:
            raise FilterError(f"{want!r} expected, not {got[1]!r}")
        self.at += 1
        return got

    def joined(self, op: str, part) -> object:
        parts = [part()]
        while self.peek() == ("word", op):
            self.next()
            parts.append(part())
        return parts[0] if len(parts) == 1 else Node(op, parts)

    def expr(self):
        return self.joined("or", lambda: self.joined("and", self.factor))

    def factor(self):
        if self.peek() == ("word", "not"):
            self.next()
            return Node("not", [self.factor()])
        if self.peek() == ("sign", "("):
            self.next()
            inner = self.expr()
            self.next(")")
            return inner
        rule = self.subject()
        while True:
            if not self.is_value(self.peek()):
                raise FilterError(f"value expected, not {self.peek()[1]!r}")
            rule.values.append(self.next())
            if not (self.peek() == ("word", "or") and self.is_value(self.peek(1))):
                return rule
            self.next()

    def is_value(self, token) -> bool:
        return token[0] in ("string", "mac", "addr", "range") or token[0] == "word" and token[1].lower() not in KEYWORDS | FUNCTIONS | set(FILTER_FIELDS)

    def subject(self) -> Rule:
        direction = self.next()[1] if self.peek()[1] in ("src", "dst") else None
        kind, name = self.next()
        if kind != "word":
            raise FilterError(f"field expected, not {name!r}")
        if name in FUNCTIONS and direction is None:
            rule = Rule({"divr": "div_r", "divl": "div_l"}.get(name, name))
            self.next("(")
            while True:
                rule.args.append(int(self.next()[1], 0) if self.peek()[0] == "range" else self.subject())
                if self.next()[1] == ")":
                    return rule
        if name not in FILTER_FIELDS and name not in COUNTERS:
            raise FilterError(f"unknown field {name!r}")
        return Rule(name, direction)


def parse(text: str):
    """The tree of a filter; None (all flows) for an empty one."""
    p = _Parser(text)
    if not p.all:
        return None
    tree = p.expr()
    if p.peek()[0] != "end":
        raise FilterError(f"unexpected {p.peek()[1]!r}")
    return tree


def _columns(rule: Rule) -> list[Column]:
    if rule.name in COUNTERS:
        name, scale = COUNTERS[rule.name]
        return [F.col(name) * scale]
    _, src, dst = FILTER_FIELDS[rule.name]
    return [F.col(c) for c in ([src] if dst is None or rule.direction == "src" else [dst] if rule.direction == "dst" else [src, dst])]


def lookup_column(rule: Rule) -> str:
    """The column in which operators.enrich puts a function that needs a database or the whole table."""
    return "__".join([rule.name, *[_column_name(a) for a in rule.args]])


def _column_name(rule: Rule) -> str:
    if rule.name not in FILTER_FIELDS:
        raise FilterError(f"{rule.name!r} isn't a field")
    _, src, dst = FILTER_FIELDS[rule.name]
    if dst is not None and rule.direction is None:
        raise FilterError(f"{rule.name} needs src or dst here")
    return dst if rule.direction == "dst" and dst is not None else src


def lookups(item) -> dict[str, Rule]:
    """The functions of a filter's tree or a field that need a database or the whole table, by their column."""
    if item is None or isinstance(item, (int, str)):
        return {}
    if isinstance(item, Node):
        return {k: v for p in item.parts for k, v in lookups(p).items()}
    return {lookup_column(item): item} if item.name in LOOKUPS or item.name == "mfreq" else {}


def value_of(rule: Rule) -> Column:
    """The column of a field with a direction, a counter, or a function."""
    one = lambda r: _columns(r)[0]
    if rule.name in LOOKUPS or rule.name == "mfreq":
        return F.col(lookup_column(rule))
    a = rule.args
    if rule.name in ("div", "div_r", "div_l"):
        return getattr(fn, rule.name)(one(a[0]), one(a[1]), *a[2:])
    if rule.name == "min":
        return fn.least(one(a[0]), one(a[1]))
    if rule.name in ("tfstr", "portstr", "ppstr"):
        return getattr(fn, rule.name)(*[one(x) for x in a])
    cols = _columns(rule)
    if len(cols) > 1:
        raise FilterError(f"{rule.name} needs src or dst here")
    return cols[0]


def _in_prefix(col: Column, value: str, wide: bool) -> Column:
    net = ipaddress.ip_network(value, strict=False)
    lo, hi = int(net.network_address), int(net.broadcast_address)
    if wide:
        return col.between(F.lit(lo.to_bytes(16, "big")), F.lit(hi.to_bytes(16, "big")))
    return col.between(F.lit(lo), F.lit(hi)) if lo != hi else col == F.lit(lo)


def kind_of(rule: Rule) -> str:
    """ADDR4, ADDR6, RANGE (a number), MAC, STRING, or TEXT (a label, whatever its case)."""
    if rule.name in FILTER_FIELDS:
        return FILTER_FIELDS[rule.name][0]
    if rule.name in GEO or rule.name == "asd":
        return "STRING"
    return "TEXT" if rule.name.endswith("str") else "RANGE"


def compile_filter(tree, lists: dict[str, list[str]] | None = None) -> Column:
    """Two-valued: absent addresses and strings never match, absent numbers count as 0."""
    lists = lists or {}
    if tree is None:
        return F.lit(True)
    if isinstance(tree, Node):
        parts = [compile_filter(p, lists) for p in tree.parts]
        if tree.op == "not":
            return ~parts[0]
        out = parts[0]
        for p in parts[1:]:
            out = out & p if tree.op == "and" else out | p
        return out
    kind = kind_of(tree)
    cols = _columns(tree) if tree.name in FILTER_FIELDS or tree.name in COUNTERS else [value_of(tree)]
    tests = []
    for what, value in tree.values:
        for col in cols:
            if kind in ("ADDR4", "ADDR6"):
                wide = kind == "ADDR6"
                for prefix in lists[value] if value in lists else [value]:
                    if (":" in prefix) == wide:
                        tests.append(F.coalesce(_in_prefix(col, prefix, wide), F.lit(False)))
            elif kind == "STRING" and tree.name in LOOKUPS:
                tests.append((col == F.lit(value)) & (col != F.lit("?")))
            elif kind in ("STRING", "MAC"):
                tests.append(F.coalesce(col == F.lit(value if kind == "STRING" else value.lower()), F.lit(False)))
            elif kind == "TEXT":
                tests.append(F.coalesce(F.lower(col) == F.lit(value.lower()), F.lit(False)))
            elif what == "word" and (found := [k for k, v in {**fn.PROTOCOLS, **({} if tree.name == "proto" else fn.PORTS)}.items() if v == value.lower()]):
                tests.append(fn.absent_as_zero(col) == F.lit(found[0]))
            elif what == "range":
                a, _, b = value.partition("-")
                lo, hi = int(a.strip(), 0), int((b or a).strip(), 0)
                tests.append(fn.absent_as_zero(col).between(F.lit(lo), F.lit(hi)) if lo != hi else fn.absent_as_zero(col) == F.lit(lo))
            else:
                raise FilterError(f"{value!r} isn't a value of {tree.name}")
    out = tests[0] if tests else F.lit(False)
    for t in tests[1:]:
        out = out | t
    return out


def where(df, text: str, lists: dict[str, list[str]] | None = None):
    return df.where(compile_filter(parse(text), lists))


@dataclass
class FieldSpec:
    """One output field: its column, its name in tables, its order, whether it is summed, and its kind."""

    column: Column
    name: str
    descending: bool
    summed: bool
    kind: str = "RANGE"
    rule: Rule | None = None


def parse_rule(text: str) -> tuple[Rule, str, bool]:
    """The rule of a field's text, its name in tables, and whether it descends; other characters of the name become _."""
    words = text.split()
    if not words:
        raise FilterError("an empty field")
    order = words.pop().lower() if words[-1].lower() in ("asc", "desc") else "asc"
    body = " ".join(words)
    p = _Parser(body)
    rule = p.subject()
    if p.peek()[0] != "end":
        raise FilterError(f"unexpected {p.peek()[1]!r}")
    return rule, re.sub(r"[^0-9A-Za-z]", "_", body), order == "desc"


def parse_field(text: str) -> FieldSpec:
    """[src|dst] field, counter or function, then asc or desc."""
    rule, name, descending = parse_rule(text)
    return FieldSpec(value_of(rule), name, descending, rule.name in COUNTERS, kind_of(rule), rule)


def describe(tree, depth: int = 0) -> str:
    """The tree as indented text."""
    pad = "  " * depth
    if tree is None:
        return pad + "all"
    if isinstance(tree, Node):
        return "\n".join([pad + tree.op, *[describe(p, depth + 1) for p in tree.parts]])
    args = f"({', '.join(a if isinstance(a, str) else str(a) if isinstance(a, int) else describe(a).strip() for a in tree.args)})" if tree.args else ""
    return pad + " ".join(x for x in (tree.direction, tree.name + args, " or ".join(v for _, v in tree.values)) if x)
