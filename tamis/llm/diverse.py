"""A varied subset by max-sum dispersion: local search over composable core-sets.

A candidate is a distinct statement, whatever its spelling, with the structure and level most often given for it, so that
neither copies nor spellings fill the subset. Members without a statement are no usable example and no candidates.

The distance of two candidates is the sum of three parts of at most 1: whether their structures differ, whether their
kinds (structure and level) differ, and the Jaccard distance of their statements' shapes and names, in units of ENOUGH and
at most 1. Total label distance is greatest where labels are spread evenly, so every kind has its part; beyond ENOUGH two
statements count as different and no more, so that outliers aren't preferred. A label that is missing on either side
adds nothing: being incomplete never makes a candidate varied.

Each partition streams its candidates in batches and keeps a core-set of the wanted size: a farthest-first start, then
swaps of a selected and an unselected candidate while the total pairwise distance increases by more than a set part.
Core-sets are merged FAN at a time, by the same search, until one is left. No task holds more than a batch and a core-set,
with a matrix of their distances; for more than MOST wanted the candidates are dealt by hash to groups which each
choose their part.

Null lists and null members are skipped, null labels are empty; ties go to the first key in order; if there are fewer
candidates than wanted, all are chosen; an empty table gives no rows. Very long statements are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache, reduce
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamis.functions.words import plain, word_text
from tamis.llm.statements import SQL_WORDS

BITS = 1024
FAN = 32
BATCH = 4096
MOST = 4096
ENOUGH = 0.4
LEAST_GAIN = 1e-4
_LITERAL = re.compile(r"'(?:[^']|'')*'?|\b\d[\d.]*\b")
_WORD = re.compile(r"[a-z_]\w*|[<>=!]+|\S")


@lru_cache(maxsize=20_000)
def _bits(statement: str) -> np.ndarray:
    words = _WORD.findall(statement)
    shape = [w if w in SQL_WORDS or not w[0].isalpha() or w == "v" else "x" for w in words]
    names = {f"2:{a} {b}" for a, b in zip(shape, shape[1:], strict=False)} | {f"3:{a} {b} {c}" for a, b, c in zip(shape, shape[1:], shape[2:], strict=False)}
    names |= {f"n:{w}" for w in words if w not in SQL_WORDS and len(w) > 2}
    return np.unique(np.array([crc32(n.encode()) % BITS for n in names], np.int64))


def features(sql: str | None) -> np.ndarray:
    """The bits of a statement's shape and names, set; statements that differ only in literals have the same."""
    bare = _LITERAL.sub(" v ", plain(sql))
    return _bits(bare) if len(bare) < 10_000 else _bits.__wrapped__(bare)


class Candidates:
    """Statements and labels of a bounded number of candidates, and the distances between them."""

    def __init__(self, structure: list[str], hardness: list[str], sql: list[str]):
        self.bits = np.zeros((len(sql), BITS), np.float32)
        for i, q in enumerate(sql):
            self.bits[i, features(q)] = 1
        self.structure = np.array(structure, object)
        self.kind = np.array([f"{s}|{h}" if s and h else "" for s, h in zip(structure, hardness, strict=True)], object)
        self._number()

    def _number(self) -> None:
        """Labels as numbers, those missing as -1."""
        self.labels = [np.where(x == "", -1, np.unique(x.astype(str), return_inverse=True)[1]) if len(x) else np.zeros(0, np.int64) for x in (self.structure, self.kind)]
        self.sizes = self.bits.sum(axis=1)

    def __len__(self) -> int:
        return len(self.bits)

    def join(self, other: Candidates) -> Candidates:
        self.bits, self.structure, self.kind = (np.concatenate([getattr(self, n), getattr(other, n)]) for n in ("bits", "structure", "kind"))
        self._number()
        return self

    def take(self, keep: np.ndarray) -> Candidates:
        self.bits, self.structure, self.kind = self.bits[keep], self.structure[keep], self.kind[keep]
        self._number()
        return self

    def distances(self, to: np.ndarray | list[int]) -> np.ndarray:
        """Of all candidates to those numbered."""
        shared = self.bits @ self.bits[to].T
        union = self.sizes[:, None] + self.sizes[to][None] - shared
        out = np.minimum(1 - shared / np.maximum(union, 1), ENOUGH) / np.float32(ENOUGH)
        for x in self.labels:
            out += (x[:, None] != x[to][None]) & (x >= 0)[:, None] & (x[to] >= 0)[None]
        return out


def disperse(of: Candidates, k: int, least_gain: float = LEAST_GAIN) -> np.ndarray:
    """The numbers of k candidates whose total pairwise distance no swap increases by more than the set part."""
    n = len(of)
    if n <= k:
        return np.arange(n)
    chosen = [0]
    near = of.distances(chosen)[:, 0]
    d = np.empty((n, k), np.float32)  # each candidate to each selected one
    d[:, 0] = near
    while len(chosen) < k:
        near[chosen] = -1
        chosen.append(int(near.argmax()))
        d[:, len(chosen) - 1] = of.distances(chosen[-1:])[:, 0]
        near = np.minimum(near, d[:, len(chosen) - 1])
    sums = d.sum(axis=1, dtype=np.float64)
    total = sums[chosen].sum() / 2
    while True:
        # the most a candidate can bring is its sum less that of the one it replaces, and their distance counts twice
        gain = sums[:, None] - d - sums[chosen][None]
        gain[chosen] = -np.inf
        new, old = np.unravel_index(int(gain.argmax()), gain.shape)
        if not gain[new, old] > least_gain * total / k:
            return np.sort(np.array(chosen))
        total += gain[new, old]
        chosen[old] = int(new)
        column = of.distances([new])[:, 0]
        sums += column.astype(np.float64) - d[:, old]
        d[:, old] = column


def _core_set(k: int):
    def core_set(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        seen: Candidates | None = None

        def lessen(more: list[pa.RecordBatch]) -> None:
            nonlocal held, seen
            table = pa.Table.from_batches(more)
            new = Candidates(*(table.column(c).to_pylist() for c in ("structure_key", "hardness_key", "sql")))
            held = table if held is None else pa.concat_tables([held, table])
            seen = new if seen is None else seen.join(new)
            keep = disperse(seen, k)
            held, seen = held.take(pa.array(keep)), seen.take(keep)

        waiting: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            for i in range(0, batch.num_rows, BATCH):
                part = batch.slice(i, BATCH)
                if size and size + part.num_rows > BATCH:
                    lessen(waiting)
                    waiting, size = [], 0
                waiting.append(part)
                size += part.num_rows
        if size:
            lessen(waiting)
        if held is not None:
            yield from held.combine_chunks().to_batches()

    return core_set


def members(df: DataFrame, column: str) -> DataFrame:
    """(key, structure, hardness, sql, structure_key, hardness_key, occurrences) of the distinct statements of an array column.

    A statement's labels are those of the pairs most often given for it in which they aren't blank; the *_key columns are
    their words.
    """
    one = df.select(F.explode(F.col(column)).alias("m")).where(F.col("m").isNotNull())
    flat = one.select(*(F.coalesce(F.col(f"m.{c}"), F.lit("")).alias(c) for c in ("structure", "hardness", "sql")))
    keyed = flat.select("*", word_text(F.col("structure")).alias("structure_key"), word_text(F.col("hardness")).alias("hardness_key"), F.sha2(word_text(F.col("sql")), 256).alias("key"), word_text(F.col("sql")).alias("_w")).where("_w != ''").drop("_w")
    # counts of a statement's spellings come first, so that a statement a third of all members hold is a few rows
    spelled = keyed.groupBy("key", "structure_key", "hardness_key").agg(F.count("*").alias("n"), F.min("sql").alias("sql"), F.max("structure").alias("structure"), F.max("hardness").alias("hardness"))
    label = lambda c: F.max(F.when(F.col(f"{c}_key") != "", F.struct("n", F.col(f"{c}_key").alias("k"), F.col(c).alias("c"))))
    best = spelled.groupBy("key").agg(F.min("sql").alias("sql"), F.sum("n").alias("occurrences"), label("structure").alias("s"), label("hardness").alias("h"))
    told = lambda c, part: F.coalesce(F.col(f"{c}.{part}"), F.lit(""))
    return best.select("key", told("s", "c").alias("structure"), told("h", "c").alias("hardness"), "sql", told("s", "k").alias("structure_key"), told("h", "k").alias("hardness_key"), "occurrences")


def _one_set(candidates: DataFrame, k: int, n: int) -> DataFrame:
    search = _core_set(k)
    step = lambda df: df.sortWithinPartitions("key").mapInArrow(search, df.schema)
    parts = max(1, -(-n // BATCH))
    kept = step(candidates.repartition(parts, "key"))
    while parts > 1:
        parts = -(-parts // FAN)
        kept = step(kept.repartition(parts, "key"))
    return kept


def varied_subset(candidates: DataFrame, k: int, most: int = MOST) -> DataFrame:
    """k of the candidates of members(), as varied as possible; all of them if they are no more."""
    n = candidates.count()
    if n <= k:
        return candidates
    groups = -(-k // most)
    if groups == 1:
        return _one_set(candidates, k, n)
    group = F.pmod(F.xxhash64("key"), F.lit(groups))
    sizes = {r["g"]: r["n"] for r in candidates.groupBy(group.alias("g")).agg(F.count("*").alias("n")).collect()}  # one row a group
    want, left = dict.fromkeys(sizes, 0), k
    while left:  # groups with fewer members than their part leave the rest to the others
        open_ = [g for g in sorted(sizes) if want[g] < sizes[g]]
        for i, g in enumerate(open_):
            want[g] = min(sizes[g], want[g] + left // len(open_) + (i < left % len(open_)))
        left = k - sum(want.values())
    return reduce(DataFrame.unionByName, [_one_set(candidates.where(group == g), w, sizes[g]) for g, w in want.items() if w])
