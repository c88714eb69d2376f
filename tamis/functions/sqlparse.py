"""A recursive-descent parser of the benchmark's SQL grammar, and the four-level hardness of a statement.

Accepted: SELECT [DISTINCT] lists of columns, aggregates and one arithmetic step; FROM with JOIN ... ON chains and
sub-queries; flat AND/OR conditions with NOT, BETWEEN, LIKE, IN (sub-query) and comparisons; GROUP BY, HAVING, ORDER BY,
LIMIT n; INTERSECT, UNION, EXCEPT. Everything else (WITH, outer or comma joins, IS NULL, EXISTS, lists of values, CASE,
CAST, window functions, column aliases, <>) is a SyntaxFault.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

# Fixed values of the grammar.
AGGREGATES = ("max", "min", "count", "sum", "avg")
COMPARISONS = ("between", "=", ">", "<", ">=", "<=", "!=", "in", "like", "is", "exists", "not")
CLAUSES = ("select", "from", "where", "group", "order", "limit", "intersect", "union", "except")
JOINS = ("join", "on", "as")
SET_OPERATORS = ("intersect", "union", "except")

_TOKEN = re.compile(r'"[^"]*"|[\w.$-]+|\S')
_TABLE = re.compile(r"(?is)create\s+table\s+(?:if\s+not\s+exists\s+)?[\"`\[]?(\w+)[\"`\]]?\s*\((.*?)\)\s*(?:;|$)")


class SyntaxFault(ValueError):
    """The statement is outside the grammar."""


@dataclass
class Column:
    aggregate: str | None
    name: str
    distinct: bool = False


@dataclass
class Unit:
    """A column, or two joined by one arithmetic operator."""

    left: Column
    operator: str | None = None
    right: Column | None = None


@dataclass
class Condition:
    negated: bool
    operator: str
    unit: Unit
    values: list


@dataclass
class Query:
    distinct: bool = False
    select: list[tuple[str | None, Unit]] = field(default_factory=list)
    sources: list = field(default_factory=list)
    joined_on: list = field(default_factory=list)
    where: list = field(default_factory=list)
    group_by: list[Column] = field(default_factory=list)
    having: list = field(default_factory=list)
    order_by: list[Unit] = field(default_factory=list)
    direction: str = "asc"  # one for the whole list: the last one seen
    limit: int | None = None
    set_operator: str | None = None
    other: Query | None = None


def tokens(sql: str) -> list[str]:
    text = sql.replace("'", '"')
    if text.count('"') % 2:
        raise SyntaxFault("open quote")
    out: list[str] = []
    for t in (x if x[0] == '"' else x.lower() for x in _TOKEN.findall(text)):
        if t == "=" and out and out[-1] in ("!", ">", "<"):
            out[-1] += "="
        else:
            out.append(t)
    return out


def catalog_of(ddl: str | None) -> dict[str, list[str]]:
    """Tables and columns of CREATE TABLE statements, in lower case."""
    out: dict[str, list[str]] = {}
    for name, body in _TABLE.findall(re.sub(r"\n\s*\)", "\n)", ddl or "")):
        flat, depth, part = [], 0, ""
        for ch in body:
            depth += (ch == "(") - (ch == ")")
            if ch == "," and not depth:
                flat.append(part)
                part = ""
            else:
                part += ch
        first = [re.match(r"\s*[\"`\[]?(\w+)", p) for p in [*flat, part]]
        out[name.lower()] = [m[1].lower() for m in first if m and m[1].lower() not in ("foreign", "primary", "unique", "check", "constraint")]
    return out


class Parser:
    def __init__(self, sql: str, catalog: dict[str, list[str]]):
        self.toks, self.at, self.catalog = tokens(sql), 0, catalog
        self.names = {self._peek_at(i + 1): self._peek_at(i - 1) for i, t in enumerate(self.toks) if t == "as"}
        if clash := self.names.keys() & catalog.keys():
            raise SyntaxFault(f"alias {sorted(clash)} is a table")
        self.names |= {t: t for t in catalog}

    def _peek_at(self, i: int) -> str:
        return self.toks[i] if 0 <= i < len(self.toks) else ""

    @property
    def now(self) -> str:
        return self._peek_at(self.at)

    def take(self, *wanted: str) -> bool:
        if self.now in wanted and self.now:
            self.at += 1
            return True
        return False

    def need(self, wanted: str) -> None:
        if not self.take(wanted):
            raise SyntaxFault(f"{wanted} expected, not {self.now!r}")

    def at_end(self) -> bool:
        return self.at >= len(self.toks)

    def closes(self) -> bool:
        return self.at_end() or self.now in CLAUSES or self.now in (")", ";")

    def statement(self) -> Query:
        """One statement; what follows it is ignored."""
        block = self.take("(")
        start = self.at
        q = Query()
        while self.now != "from":
            if self.at_end():
                raise SyntaxFault("no FROM")
            self.at += 1
        self.at += 1
        known = self._sources(q)
        after = self.at
        self.at = start
        self._select(q, known)
        self.at = after
        if self.take("where"):
            q.where = self._conditions(known)
        if self.take("group"):
            self.need("by")
            while not self.closes():
                q.group_by.append(self._column(known))
                if not self.take(","):
                    break
        if self.take("having"):
            q.having = self._conditions(known)
        if self.take("order"):
            self.need("by")
            while not self.closes():
                q.order_by.append(self._unit(known))
                if self.now in ("asc", "desc"):
                    q.direction = self.now
                    self.at += 1
                if not self.take(","):
                    break
        if self.take("limit"):
            if not self.now.isdigit():
                raise SyntaxFault("LIMIT without a number")
            q.limit = int(self.now)
            self.at += 1
        while self.take(";"):
            pass
        if block:
            self.need(")")
        while self.take(";"):
            pass
        if self.now in SET_OPERATORS:
            q.set_operator = self.now
            self.at += 1
            q.other = self.statement()
        return q

    def _sources(self, q: Query) -> list[str]:
        known: list[str] = []
        while not self.at_end():
            block = self.take("(")
            if self.now == "select":
                q.sources.append(self.statement())
            else:
                self.take("join")
                table = self.names.get(self.now)
                if table not in self.catalog:
                    raise SyntaxFault(f"unknown table {self.now!r}")
                self.at += 3 if self._peek_at(self.at + 1) == "as" else 1
                q.sources.append(table)
                known.append(table)
            if self.take("on"):
                found = self._conditions(known)
                q.joined_on += (["and"] if q.joined_on else []) + found
            if block:
                self.need(")")
            if self.closes():
                break
        if not q.sources:
            raise SyntaxFault("empty FROM")
        return known

    def _select(self, q: Query, known: list[str]) -> None:
        self.need("select")
        q.distinct = self.take("distinct")
        while not self.at_end() and self.now not in CLAUSES:
            aggregate = self.now if self.now in AGGREGATES else None
            self.at += aggregate is not None
            q.select.append((aggregate, self._unit(known)))
            self.take(",")

    def _unit(self, known: list[str]) -> Unit:
        block = self.take("(")
        unit = Unit(self._column(known))
        if self.now in ("-", "+", "*", "/"):
            unit.operator = self.now
            self.at += 1
            unit.right = self._column(known)
        if block:
            self.need(")")
        return unit

    def _column(self, known: list[str]) -> Column:
        block = self.take("(")
        if self.now in AGGREGATES:
            aggregate = self.now
            self.at += 1
            self.need("(")
            distinct = self.take("distinct")
            out = Column(aggregate, self._name(known), distinct)
            self.need(")")
            return out
        distinct = self.take("distinct")
        out = Column(None, self._name(known), distinct)
        if block:
            self.need(")")
        return out

    def _name(self, known: list[str]) -> str:
        t = self.now
        self.at += 1
        if t == "*":
            return t
        if t.count(".") == 1:
            alias, name = t.split(".")
            table = self.names.get(alias)
            if name in self.catalog.get(table, ()):
                return f"{table}.{name}"
        else:
            for table in known:
                if t in self.catalog[table]:
                    return f"{table}.{t}"
        raise SyntaxFault(f"unknown column {t!r}")

    def _conditions(self, known: list[str]) -> list:
        out: list = []
        while not self.at_end():
            unit = self._unit(known)
            negated = self.take("not")
            if self.now not in COMPARISONS:
                raise SyntaxFault(f"comparison expected, not {self.now!r}")
            operator = self.now
            self.at += 1
            values = [self._value(known)]
            if operator == "between":
                self.need("and")
                values.append(self._value(known))
            out.append(Condition(negated, operator, unit, values))
            if self.closes() or self.now in JOINS:
                break
            if self.now in ("and", "or"):
                out.append(self.now)
                self.at += 1
        return out

    def _value(self, known: list[str]):
        block = self.take("(")
        if self.now == "select":
            value = self.statement()
        elif self.now[:1] == '"':
            value = self.now
            self.at += 1
        else:
            try:
                value = float(self.now)
                self.at += 1
            except ValueError:
                value = self._column(known)
                while not self.closes() and self.now not in (",", "and", *JOINS):
                    self.at += 1
        if block:
            self.need(")")
        return value


def parse(sql: str, catalog: dict[str, list[str]]) -> Query:
    try:
        return Parser(sql, catalog).statement()
    except RecursionError as e:
        raise SyntaxFault("nested too deeply") from e


def components(q: Query) -> tuple[int, int, int]:
    """(clauses and joins, nested statements, other signs of effort); connectors count as the grammar lists them."""
    every = [*q.joined_on, *q.where, *q.having]
    conditions = [c for c in every if isinstance(c, Condition)]
    one = bool(q.where) + bool(q.group_by) + bool(q.order_by) + (q.limit is not None) + len(q.sources) - 1
    one += sum(c == "or" for c in every) + sum(c.operator == "like" for c in conditions if isinstance(c, Condition))
    two = sum(isinstance(v, Query) for c in conditions for v in c.values) + (q.other is not None)
    aggregates = sum(a is not None for a, _ in q.select) + sum(c.aggregate is not None for c in q.group_by)
    # In WHERE a NOT counts like an aggregate; in HAVING each connector does too.
    aggregates += sum(c.negated for c in q.where if isinstance(c, Condition))
    aggregates += sum(not isinstance(c, Condition) or c.negated for c in q.having)
    aggregates += sum(c.aggregate is not None for u in q.order_by for c in (u.left, u.right) if c)
    others = (aggregates > 1) + (len(q.select) > 1) + (len(q.where) > 1) + (len(q.group_by) > 1)
    return one, two, others


def hardness(q: Query) -> str:
    one, two, others = components(q)
    if not two:
        if one <= 1 and not others:
            return "easy"
        if (others <= 2 and one <= 1) or (one <= 2 and others < 2):
            return "medium"
        if (others > 2 and one <= 2) or (one == 3 and others <= 2):
            return "hard"
    elif two == 1 and one <= 1 and not others:
        return "hard"
    return "extra"


def classify(sql: str | None, catalog: dict[str, list[str]]) -> tuple[str | None, str | None]:
    """(hardness, None) or (None, reason)."""
    try:
        return hardness(parse(sql or "", catalog)), None
    except SyntaxFault as e:
        return None, str(e)


def with_hardness(df: DataFrame, sql: str, ddl: str, name: str = "parsed_hardness") -> DataFrame:
    """Adds the hardness of a statement over the tables of a DDL text; null where the grammar rejects it.

    Catalogs are parsed once a process and DDL text.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str | None, dict] = {}
        for batch in batches:
            levels = []
            for s, d in zip(batch.column(sql).to_pylist(), batch.column(ddl).to_pylist(), strict=True):
                if d not in known:
                    if len(known) > 5000:
                        known.clear()
                    known[d] = catalog_of(d)
                levels.append(classify(s, known[d])[0])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(levels, pa.string())], [*batch.schema.names, name])

    from pyspark.sql import types as T

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(name, T.StringType())]))
