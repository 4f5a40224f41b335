"""The engine's SQL dialect: one SELECT over registered tables, compiled to a lazy DataFrame.

SELECT list FROM table [alias] {[INNER|LEFT|RIGHT|FULL [OUTER]] JOIN table [alias] ON a.x = b.y}
[WHERE] [GROUP BY] [HAVING] [ORDER BY x [ASC|DESC], ...] [LIMIT n]

Where it differs from ANSI SQL: = , IN and LIKE ignore case on strings, <> doesn't and holds for null; aggregates are
rounded to two decimals, halves up; a column keeps the name it was written with; text in double quotes is a string;
parameters :msg.path, :flow.path, :global.path are bound as values, never as text. Strict() turns these off.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LEX = re.compile(r"""\s*(?:(?P<num>-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w.]))|(?P<str>'(?:[^']|'')*'|"(?:[^"]|"")*")|(?P<par>:[A-Za-z_]\w*(?:\.\w+)*)
    |(?P<name>`[^`]+`|[A-Za-z_][\w$]*(?:\.(?:[A-Za-z_][\w$]*|\*))*)|(?P<op><>|!=|>=|<=|=|<|>|\(|\)|,|\*|\?))""", re.X)  # fmt: skip
_AGGREGATES = ("COUNT", "SUM", "AVG", "MIN", "MAX")
_END = frozenset("FROM WHERE GROUP HAVING ORDER LIMIT INNER LEFT RIGHT FULL OUTER JOIN ON AS AND OR NOT BETWEEN IN LIKE IS NULL ASC DESC BY".split())


class SqlError(ValueError):
    pass


@dataclass
class Expr:
    """kind: name, value, param, agg, or a predicate's operator; text: as written."""

    kind: str
    args: tuple = ()
    text: str = ""


@dataclass
class Plan:
    select: list[tuple[Expr, str]] = field(default_factory=list)
    star: bool = False
    table: str = ""
    alias: str = ""
    joins: list[tuple[str, str, str, Expr, Expr]] = field(default_factory=list)
    where: Expr | None = None
    group: list[Expr] = field(default_factory=list)
    having: Expr | None = None
    order: list[tuple[Expr, bool]] = field(default_factory=list)
    limit: int | None = None


class _Parser:
    def __init__(self, sql: str) -> None:
        self.tokens: list[tuple[str, str]] = []
        at = 0
        sql = sql.rstrip().rstrip(";")
        while at < len(sql):
            m = _LEX.match(sql, at)
            if not m:
                raise SqlError(f"Unexpected text at {at}: {sql[at : at + 20]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self, ahead: int = 0) -> tuple[str, str]:
        return self.tokens[self.at + ahead] if self.at + ahead < len(self.tokens) else ("end", "")

    def word(self, *words: str) -> bool:
        """Takes the words if they come next."""
        for k, w in enumerate(words):
            kind, text = self.peek(k)
            if kind not in ("name", "op") or text.upper() != w:
                return False
        self.at += len(words)
        return True

    def need(self, *words: str) -> None:
        if not self.word(*words):
            raise SqlError(f"Expected {' '.join(words)}, found {self.peek()[1] or 'the end'!r}")

    def name(self) -> str:
        kind, text = self.peek()
        if kind == "str" or (kind == "name" and text.upper() not in _END) or text == "?":
            self.at += 1
            return text.strip("`'\"")
        raise SqlError(f"Expected a name, found {text or 'the end'!r}")

    def operand(self) -> Expr:
        kind, text = self.peek()
        self.at += 1
        if kind == "num":
            return Expr("value", (float(text) if re.search(r"[.eE]", text) else int(text),), text)
        if kind == "str":
            q = text[0]
            return Expr("value", (text[1:-1].replace(q * 2, q),), text)
        if kind == "par":
            return Expr("param", (text,), text)
        if kind == "name" and text.upper() in _AGGREGATES and self.peek()[1] == "(":
            self.at += 1
            distinct = self.word("DISTINCT")
            arg = "*" if self.word("*") else self.name()
            self.need(")")
            return Expr("agg", (text.upper(), arg, distinct), f"{text}({'DISTINCT ' * distinct}{arg})")
        if kind == "name" and text.upper() == "NULL":
            return Expr("value", (None,), text)
        if kind == "name" and text.upper() in ("TRUE", "FALSE"):
            return Expr("value", (text.upper() == "TRUE",), text)
        if kind == "name" and text.upper() not in _END:
            return Expr("name", (text.strip("`"),), text.strip("`"))
        raise SqlError(f"Expected a value, found {text or 'the end'!r}")

    def condition(self) -> Expr:
        parts = [self.conjunction()]
        while self.word("OR"):
            parts.append(self.conjunction())
        return parts[0] if len(parts) == 1 else Expr("or", tuple(parts))

    def conjunction(self) -> Expr:
        parts = [self.predicate()]
        while self.word("AND"):
            parts.append(self.predicate())
        return parts[0] if len(parts) == 1 else Expr("and", tuple(parts))

    def predicate(self) -> Expr:
        if self.word("NOT"):
            return Expr("not", (self.predicate(),))
        if self.word("("):
            inner = self.condition()
            self.need(")")
            return inner
        left = self.operand()
        if self.word("IS"):
            no = self.word("NOT")
            self.need("NULL")
            out = Expr("null", (left,))
            return Expr("not", (out,)) if no else out
        no = self.word("NOT")
        if self.word("BETWEEN"):
            low = self.operand()
            self.need("AND")
            out = Expr("between", (left, low, self.operand()))
        elif self.word("IN"):
            self.need("(")
            items = [self.operand()]
            while self.word(","):
                items.append(self.operand())
            self.need(")")
            out = Expr("in", (left, *items))
        elif self.word("LIKE"):
            out = Expr("like", (left, self.operand()))
        elif not no and self.peek()[1] in ("=", "!=", "<>", "<", ">", "<=", ">="):
            op = self.peek()[1]
            self.at += 1
            out = Expr("!=" if op == "<>" else op, (left, self.operand()))
        else:
            raise SqlError(f"Expected a predicate, found {self.peek()[1] or 'the end'!r}")
        return Expr("not", (out,)) if no else out

    def aliased(self) -> str:
        if self.word("AS"):
            return self.name()
        kind, text = self.peek()
        return self.name() if kind == "name" and text.upper() not in _END else ""

    def plan(self) -> Plan:
        p = Plan()
        self.need("SELECT")
        while True:
            if self.word("*"):
                p.star = True
            else:
                e = self.operand()
                p.select.append((e, self.aliased()))
            if not self.word(","):
                break
        self.need("FROM")
        p.table = self.name()
        p.alias = self.aliased()
        while True:
            for words, how in ((("INNER", "JOIN"), "inner"), (("JOIN",), "inner"), (("LEFT", "OUTER", "JOIN"), "left"), (("LEFT", "JOIN"), "left"), (("RIGHT", "OUTER", "JOIN"), "right"), (("RIGHT", "JOIN"), "right"), (("FULL", "OUTER", "JOIN"), "full"), (("FULL", "JOIN"), "full")):
                if self.word(*words):
                    break
            else:
                break
            table, alias = self.name(), self.aliased()
            self.need("ON")
            left = self.operand()
            self.need("=")
            p.joins.append((how, table, alias, left, self.operand()))
        if self.word("WHERE"):
            p.where = self.condition()
        if self.word("GROUP", "BY"):
            p.group = [self.operand()]
            while self.word(","):
                p.group.append(self.operand())
        if self.word("HAVING"):
            p.having = self.condition()
        if self.word("ORDER", "BY"):
            while True:
                e = self.operand()
                down = self.word("DESC")
                if not down:
                    self.word("ASC")
                p.order.append((e, down))
                if not self.word(","):
                    break
        if self.word("LIMIT"):
            kind, text = self.peek()
            if kind != "num":
                raise SqlError("LIMIT needs a number")
            self.at += 1
            p.limit = int(text)
        if self.peek()[0] != "end":
            raise SqlError(f"Unexpected {self.peek()[1]!r}")
        return p


def parse_sql(sql: str) -> Plan:
    return _Parser(sql).plan()


def lookup(params: dict, path: str):
    """The value of a parameter such as :msg.payload.minAge in {"msg": ..., "flow": ..., "global": ...}."""
    value = params
    for part in path[1:].split("."):
        if not isinstance(value, dict) or part not in value:
            raise SqlError(f"Parameter '{path}' not provided")
        value = value[part]
    return value


class _Compiler:
    def __init__(self, df: DataFrame, params: dict, ignore_case: bool, digits: int | None) -> None:
        self.df, self.params, self.ignore_case, self.digits = df, params, ignore_case, digits
        self.types = {f.name: f.dataType for f in df.schema.fields}
        self.aliases: dict[str, str] = {}

    def resolve(self, name: str) -> str:
        if name in self.types:
            return name
        if name in self.aliases:
            return self.aliases[name]
        found = [c for c in self.types if c.rpartition(".")[2] == name]
        if not found:
            found = [c for c in self.types if c.lower() == name.lower() or c.rpartition(".")[2].lower() == name.lower()]
        if not found:
            raise SqlError(f'Column "{name}" not found')
        if len(found) > 1:
            raise SqlError(f'Column "{name}" is ambiguous: {", ".join(found)}')
        return found[0]

    def value(self, e: Expr) -> tuple[Column, T.DataType]:
        if e.kind == "agg":
            name = self.resolve(default_name(e))
            return F.col(f"`{name}`"), self.types[name]
        if e.kind == "name":
            name = self.resolve(e.args[0])
            return F.col(f"`{name}`"), self.types[name]
        v = e.args[0] if e.kind == "value" else lookup(self.params, e.args[0])
        kind = T.StringType() if isinstance(v, str) else T.BooleanType() if isinstance(v, bool) else T.LongType() if isinstance(v, int) else T.DoubleType() if isinstance(v, float) else T.NullType()
        return F.lit(v), kind

    def pair(self, a: Expr, b: Expr) -> tuple[Column, Column, bool]:
        """Both sides, comparable; whether they are strings."""
        (x, s), (y, t) = self.value(a), self.value(b)
        texts = isinstance(s, T.StringType), isinstance(t, T.StringType)
        if texts[0] != texts[1] and not isinstance(s, T.NullType) and not isinstance(t, T.NullType):
            number = t if texts[0] else s
            if isinstance(number, T.NumericType):
                return (x.try_cast("double") if texts[0] else x), (y.try_cast("double") if texts[1] else y), False
            return x.cast("string"), y.cast("string"), True
        return x, y, all(texts)

    def condition(self, e: Expr) -> Column:
        if e.kind in ("and", "or"):
            parts = [self.condition(x) for x in e.args]
            return reduce(lambda a, b: (a & b) if e.kind == "and" else (a | b), parts)
        if e.kind == "not":
            return ~self.condition(e.args[0])
        if e.kind == "null":
            return self.value(e.args[0])[0].isNull()
        if e.kind == "between":
            left, low, high = e.args
            (a, b, _), (c, d, _) = self.pair(left, low), self.pair(left, high)
            return (a >= b) & (c <= d)
        if e.kind == "in":
            return reduce(lambda a, b: a | b, (self.condition(Expr("=", (e.args[0], x))) for x in e.args[1:]))
        if e.kind == "like":
            x, y = self.value(e.args[0])[0].cast("string"), self.value(e.args[1])[0].cast("string")
            return F.ilike(x, y) if self.ignore_case else F.like(x, y)
        x, y, texts = self.pair(*e.args)
        if e.kind == "=":
            return F.lower(x) == F.lower(y) if texts and self.ignore_case else x == y
        if e.kind == "!=":
            return ~x.eqNullSafe(y) if self.ignore_case else x != y
        return {"<": x < y, ">": x > y, "<=": x <= y, ">=": x >= y}[e.kind]

    def aggregate(self, e: Expr) -> Column:
        fn, arg, distinct = e.args
        if arg == "*":
            return F.count(F.lit(1))
        c = F.col(f"`{self.resolve(arg)}`")
        if fn == "COUNT":
            return F.count_distinct(c) if distinct else F.count(c)
        out = {"SUM": F.sum, "AVG": F.avg, "MIN": F.min, "MAX": F.max}[fn](c)
        kind = self.types[self.resolve(arg)]
        if self.digits is not None and (fn == "AVG" or isinstance(kind, (T.DoubleType, T.FloatType))):
            k = 10.0**self.digits
            out = F.floor(out * k + 0.5) / k
        return out


def default_name(e: Expr) -> str:
    fn, arg, distinct = e.args
    return f"{fn.lower()}_{'distinct_' * distinct}{arg}"


def _aggregates(e) -> list[Expr]:
    if e is None:
        return []
    return [e] if e.kind == "agg" else [x for a in e.args if isinstance(a, Expr) for x in _aggregates(a)]


def run_sql(plan: Plan | str, table: Callable[[str], DataFrame], params: dict | None = None, ignore_case: bool = True, digits: int | None = 2) -> DataFrame:
    """The DataFrame of a plan. table(name) gives a table or raises. digits=None: aggregates aren't rounded."""
    p = parse_sql(plan) if isinstance(plan, str) else plan
    params = params or {}
    df = table(p.table)
    if p.joins:
        first = p.alias or p.table
        df = df.select(*(F.col(f"`{c}`").alias(f"{first}.{c}") for c in df.columns))
        for how, name, alias, left, right in p.joins:
            other = table(name)
            other = other.select(*(F.col(f"`{c}`").alias(f"{alias or name}.{c}") for c in other.columns))
            here, there = _Compiler(df, params, ignore_case, digits), _Compiler(other, params, ignore_case, digits)
            mine = left if f"{left.args[0]}" not in other.columns else right
            yours = right if mine is left else left
            a, b = df[f"`{here.resolve(mine.args[0])}`"], other[f"`{there.resolve(yours.args[0])}`"]
            if type(here.types[here.resolve(mine.args[0])]) is not type(there.types[there.resolve(yours.args[0])]) and T.StringType() in (here.types[here.resolve(mine.args[0])], there.types[there.resolve(yours.args[0])]):
                a, b = a.cast("string"), b.cast("string")
            df = df.join(other, a == b, how)
    elif p.alias:
        wanted = f"{p.alias}."
        strip = lambda e: e if not isinstance(e, Expr) else Expr(e.kind, tuple(strip(a) if isinstance(a, Expr) else a.removeprefix(wanted) if isinstance(a, str) and e.kind in ("name", "agg") else a for a in e.args), e.text)
        p = Plan([(strip(e), a or (e.text if e.kind == "name" else "")) for e, a in p.select], p.star, p.table, "", [], strip(p.where), [strip(e) for e in p.group], strip(p.having), [(strip(e), d) for e, d in p.order], p.limit)
    c = _Compiler(df, params, ignore_case, digits)
    if p.where is not None:
        df = df.where(c.condition(p.where))
    aggregates = [e for e, _ in p.select if e.kind == "agg"] + _aggregates(p.having) + [x for e, _ in p.order for x in _aggregates(e)]
    names = {a: e for e, a in p.select if a}
    if aggregates or p.group:
        keys = [c.resolve(names[e.args[0]].args[0] if e.args[0] in names and names[e.args[0]].kind == "name" and e.args[0] not in c.types else e.args[0]) for e in p.group]
        made = {default_name(e): c.aggregate(e).alias(default_name(e)) for e in aggregates} or {"count_*": F.count(F.lit(1)).alias("count_*")}
        df = df.groupBy(*(F.col(f"`{k}`") for k in keys)).agg(*made.values())
        c = _Compiler(df, params, ignore_case, digits)
    c.aliases = {a: (default_name(e) if e.kind == "agg" else c.resolve(e.args[0])) for a, e in names.items() if e.kind in ("agg", "name")}
    if p.having is not None:
        df = df.where(c.condition(p.having))
    if p.order:
        df = df.orderBy(*(c.value(e)[0].desc_nulls_last() if down else c.value(e)[0].asc_nulls_first() for e, down in p.order))
    if p.limit is not None:
        df = df.limit(p.limit)
    out = []
    if p.star:
        short = [x.rpartition(".")[2] for x in df.columns]
        out = [F.col(f"`{x}`").alias(s if short.count(s) == 1 else x) for x, s in zip(df.columns, short)]
    for e, a in p.select:
        out.append(c.value(e)[0].alias(a or (default_name(e) if e.kind == "agg" else e.text)))
    return df.select(*out)
