"""Deeply nested JSON records turned into related flat tables.

The merged schema is inferred from all records: one narrow pass collects the distinct (path, kind) pairs, which
Spark counts; only that small result reaches the driver. Tables are then taken from VARIANT values inside the JVM.
Each array level becomes a child table whose rows hold their own surrogate key, the parent's key and the ordinal.

How values of several shapes are read:
  * a path that holds a list somewhere is a child table everywhere: a lone object or scalar there is a list of one,
    null or an absent field is an empty list;
  * a path that holds an object somewhere but never a list is flattened into columns; text there that is itself
    JSON of an object is read as that object, other text is kept in the column of the path;
  * any other path is a column: bigint, double or boolean if all values are, else string.
Records that aren't valid JSON (null, empty or broken text) give no row. An empty table gives an empty root table.
Rows that share a key value each give their rows; surrogate keys are unique as far as the given key is.
Only the key and the JSON column are read, so other columns may have any name.

Keys that are data (an object with an id as each key) make the schema as large as the data. Then the fields to read are
named: `fields` gives their paths, lists passed through, and only what lies on or below them is inferred; all else may have
any number of keys. Without fields more than MAX_PATHS different paths raise. Tasks send their paths on in parts of FLUSH.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ELEMENT, ENCODED = 0, 1  # marks in a path: an element of a list; JSON held as text
MAX_PATHS = 200_000
FLUSH = 50_000


@dataclass
class Node:
    """A place in the merged schema."""

    kinds: Counter = field(default_factory=Counter)
    children: dict[str, Node] = field(default_factory=dict)
    element: Node | None = None
    encoded: Node | None = None

    @property
    def is_list(self) -> bool:
        return "array" in self.kinds

    @property
    def is_object(self) -> bool:
        return "object" in self.kinds and not self.is_list

    def merge(self, other: Node) -> Node:
        self.kinds += other.kinds
        for k, c in other.children.items():
            self.children[k] = self.children.get(k, Node()).merge(c)
        for part in ("element", "encoded"):
            if (theirs := getattr(other, part)) is not None:
                setattr(self, part, (getattr(self, part) or Node()).merge(theirs))
        return self

    def settle(self) -> Node:
        """Applies the rules for values of several shapes, from the top down."""
        if self.is_list:
            element = (self.element or Node()).merge(Node(Counter({k: n for k, n in self.kinds.items() if k not in ("array", "null")}), self.children))
            self.element, self.children, self.encoded = element.settle(), {}, None
        elif self.is_object and self.encoded is not None:
            self.merge(Node(Counter(), self.encoded.children))
        for c in self.children.values():
            c.settle()
        return self

    @property
    def sql_type(self) -> str:
        kinds = set(self.kinds) - {"null", "object"}
        if self.is_object or not kinds:
            return "string"
        if kinds <= {"int"}:
            return "bigint"
        if kinds <= {"int", "float"}:
            return "double"
        return "boolean" if kinds == {"bool"} else "string"


def _kind(x: object) -> str:
    if x is None:
        return "null"
    if isinstance(x, bool):
        return "bool"
    if isinstance(x, int):
        return "int" if -(1 << 63) <= x < 1 << 63 else "string"
    return {dict: "object", list: "array", float: "float"}.get(type(x), "string")


def _walk(record: object, seen: Counter, wanted: dict | None) -> None:
    """Counts the paths of a record; wanted: the named fields as nested dicts, where an empty one wants all below."""
    todo: list[tuple[tuple, object, dict | None]] = [((), record, wanted)]
    while todo:
        path, x, below = todo.pop()
        seen[path, _kind(x)] += 1
        if isinstance(x, dict):
            if below:
                todo += [((*path, k), x[k], below[k]) for k in below if k in x]
            else:
                todo += [((*path, k), v, None) for k, v in x.items()]
        elif isinstance(x, list):
            todo += [((*path, ELEMENT), v, below) for v in x]
        elif isinstance(x, str) and x[:1] == "{" and ENCODED not in path:
            try:
                inner = json.loads(x)
            except ValueError:
                continue
            todo.append(((*path, ENCODED), inner, below))


def _tree(fields: Iterable[Iterable[str]] | None) -> dict | None:
    """Named fields as nested dicts; a field below another named one is part of it."""
    paths = sorted(map(tuple, fields or ()), key=len)
    kept = [p for i, p in enumerate(paths) if not any(p[: len(q)] == q for q in paths[:i])]
    root: dict = {}
    for path in kept:
        at = root
        for step in path:
            at = at.setdefault(step, {})
    return root or None


def _inventory(wanted: dict | None):
    def rows(seen: Counter) -> pa.RecordBatch:
        found = [(json.dumps(p), k, n) for (p, k), n in seen.items()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], ["path", "kind", "n"])

    def inventory(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                try:
                    _walk(json.loads(raw), seen, wanted)
                except (ValueError, TypeError, RecursionError):
                    continue
                if len(seen) > FLUSH:
                    yield rows(seen)
                    seen.clear()
        yield rows(seen)

    return inventory


def infer_schema(df: DataFrame, column: str, fields: Iterable[Iterable[str]] | None = None, most: int = MAX_PATHS) -> Node:
    """The merged schema of all records, or of the named fields."""
    found = df.select(F.col(column)).mapInArrow(_inventory(_tree(fields)), "path string, kind string, n bigint").groupBy("path", "kind").agg(F.sum("n").alias("n"))
    rows = found.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} different paths: keys seem to be data; name the fields to read with fields=[('a', 'b'), ...]")
    root = Node()
    for r in rows:
        at = root
        for step in json.loads(r["path"]):
            if step == ELEMENT and isinstance(step, int):
                at.element = at = at.element or Node()
            elif step == ENCODED and isinstance(step, int):
                at.encoded = at = at.encoded or Node()
            else:
                at = at.children.setdefault(step, Node())
        at.kinds[r["kind"]] += r["n"]
    return root.settle()


def _step(name: str) -> str:
    """A key as a step of a VARIANT path; keys with both sorts of quotes can't be written so."""
    return f"[\"{name}\"]" if '"' not in name else f"['{name}']"


def _get(v: Column, names: Iterable[str], kind: str) -> Column:
    return F.try_variant_get(v, "$" + "".join(map(_step, names)), kind)


def _as_object(v: Column, node: Node) -> Column:
    if node.encoded is None:
        return v
    return F.when(F.schema_of_variant(v).startswith("OBJECT"), v).otherwise(F.try_parse_json(F.try_variant_get(v, "$", "string")))


def _plain_text(v: Column, node: Node) -> Column:
    """The text of a value that is neither an object nor JSON of one."""
    return F.when(~F.coalesce(F.schema_of_variant(_as_object(v, node)).startswith("OBJECT"), F.lit(False)), F.try_variant_get(v, "$", "string"))


def _as_list(v: Column) -> Column:
    one = F.when(v.isNotNull() & ~F.is_variant_null(v), F.array(v))
    return F.coalesce(F.try_variant_get(v, "$", "array<variant>"), one)


def _element(path: str):
    return lambda x, i: F.struct(i.alias("i"), F.concat(F.lit(f"/{path}:"), i.cast("string")).alias("s"), x.alias("v"))


class NestedRecords:
    """The flat tables of the JSON records in a column; key names the column that identifies a record."""

    def __init__(self, df: DataFrame, column: str, key: str, fields: Iterable[Iterable[str]] | None = None):
        self.schema = infer_schema(df, column, fields)
        self.key = key
        # The parser stops after the first value; as a list's first of two elements the text must be one whole value.
        pair = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), F.col(column), F.lit(",0]"))), "$", "array<variant>")
        self.root = (
            df.select(F.col(key).alias("_key"), pair.alias("_p"))
            .where(F.size("_p") == 2)
            .select("_key", F.col("_p")[0].alias("_v"))
            .select("_key", F.col("_key").cast("string").alias("_id"), "_v")
        )

    def node(self, path: Iterable[str]) -> Node | None:
        """The node at a path of keys; lists on the way are passed through."""
        at: Node | None = self.schema
        for step in path:
            while at is not None and at.is_list:
                at = at.element
            at = at.children.get(step) if at is not None else None
        return at

    def value(self, v: Column, level: Node, path: Iterable[str], kind: str | None = None) -> Column:
        """The value at a path below a level, with no list between; null if the schema hasn't the path."""
        names: list[str] = []
        at = level
        for step in path:
            if at.encoded is not None and at.is_object:
                v, names = _as_object(_get(v, names, "variant") if names else v, at), []
            if (below := at.children.get(step)) is None:
                return F.lit(None).cast(kind or "string")
            at, names = below, [*names, step]
        if kind is None and at.is_object:
            return _plain_text(_get(v, names, "variant"), at)
        return _get(v, names, kind or at.sql_type)

    def explode(self, df: DataFrame, level: Node, *paths: Iterable[str], outer: bool = False, ordinal: str = "_ordinal") -> DataFrame:
        """The rows of a child level, narrow: no shuffle. Further paths are other places for the same list.

        With outer, a parent without elements gives one row with ordinal -1. Other columns of df are carried along.
        """
        lists = []
        for path in map(tuple, paths):
            v = self.value(F.col("_v"), level, path, "variant")
            lists.append(F.coalesce(F.transform(_as_list(v), _element("/".join(path))), F.array()))
        both = lists[0] if len(lists) == 1 else F.concat(*lists)
        rest = [c for c in df.columns if c not in ("_v", "_id", "_parent", ordinal)]
        rows = df.select(*rest, F.col("_id").alias("_parent"), (F.explode_outer if outer else F.explode)(both).alias("_e"))
        return rows.select(*rest, "_parent", F.concat("_parent", "_e.s").alias("_id"), F.coalesce("_e.i", F.lit(-1)).cast("bigint").alias(ordinal), F.col("_e.v").alias("_v"))

    def _columns(self, level: Node) -> tuple[list[tuple[str, tuple[str, ...]]], list[tuple[str, ...]]]:
        """Scalar columns and child lists of a level."""
        columns: list[tuple[str, tuple[str, ...]]] = []
        lists: list[tuple[str, ...]] = []
        taken = {"_key", "_id", "_parent", "_ordinal"}
        todo: list[tuple[tuple[str, ...], Node]] = [((), level)]
        while todo:
            path, at = todo.pop(0)
            if path and at.is_list:
                lists.append(path)
                continue
            if path and (not at.is_object or set(at.kinds) - {"object", "null"}):
                name, n = "_".join(path), 2
                while name.lower() in taken:
                    name, n = f"{'_'.join(path)}_{n}", n + 1
                taken.add(name.lower())
                columns.append((name, path))
            todo += [((*path, k), c) for k, c in sorted(at.children.items())]
        return columns, lists

    def tables(self) -> dict[str, DataFrame]:
        """All flat tables by path ('' is the root); each child row has _id, _parent and _ordinal."""
        out: dict[str, DataFrame] = {}

        def build(name: str, rows: DataFrame, level: Node) -> None:
            columns, lists = self._columns(level)
            if not level.is_object and set(level.kinds) - {"object", "null"} and not level.is_list:
                value = [_get(F.col("_v"), (), level.sql_type).alias("value")]
            elif level.is_object and set(level.kinds) - {"object", "null"}:
                value = [_plain_text(F.col("_v"), level).alias("value")]
            else:
                value = []
            keys = ["_key", "_id"] + [c for c in ("_parent", "_ordinal") if c in rows.columns]
            out[name] = rows.select(*keys, *value, *(self.value(F.col("_v"), level, p).alias(c) for c, p in columns))
            if level.is_list:
                lists = [()]
            for path in lists:
                node = level
                for step in path:
                    node = node.children[step]
                child = ".".join(x for x in (name, *path) if x) + ("[]" if not path else "")
                build(child, self.explode(rows, level, path), node.element)

        build("", self.root, self.schema)
        return out
