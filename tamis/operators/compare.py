"""Comparison of result sets: strict, as bags, and with columns permuted.

A result is an array of rows, each an array of tagged cells: n (null), i:1, r:1.5, t:text, b:hex. Strict equality lets
1 equal 1.0, as numbers do; bags compare the written form, where they differ (K4).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import permutations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

MOST_COLUMNS = 6


def cell(x: object) -> str:
    """The tagged form of a value."""
    if x is None:
        return "n"
    if isinstance(x, bool):
        return f"i:{int(x)}"
    if isinstance(x, int):
        return f"i:{x}"
    if isinstance(x, float):
        return f"r:{x!r}"
    if isinstance(x, (bytes, bytearray)):
        return f"b:{bytes(x).hex()}"
    return f"t:{x}"


def unified(rows: Column) -> Column:
    """Whole reals written as integers, so that 1 and 1.0 compare equal."""
    return F.transform(rows, lambda row: F.transform(row, lambda c: F.regexp_replace(c, r"^(?:r:(-?[0-9]+)\.0|i:(-?[0-9]+))$", "i:$1$2")))


def strictly_equal(a: Column, b: Column) -> Column:
    return F.coalesce(unified(a) == unified(b), F.lit(False))


def bags_equal(a: Column, b: Column, ordered: Column) -> Column:
    """As lists if the gold statement orders, else as bags of rows."""
    return F.coalesce(F.when(ordered, a == b).otherwise(F.array_sort(a) == F.array_sort(b)), F.lit(False))


def _columns_match(a: list, b: list, ordered: bool) -> bool:
    if not len(a) or not len(b) or len(a) != len(b):
        return False
    width = len(a[0])
    if width != len(b[0]) or width > MOST_COLUMNS:
        return False
    gold = [tuple(r) for r in b]
    wanted = gold if ordered else Counter(gold)
    # a column can only stand for one with the same values
    values = lambda rows: [tuple(sorted(r[i] for r in rows)) for i in range(width)]
    have, want = values(a), values(b)
    for order in permutations(range(width)):
        if all(have[order[i]] == want[i] for i in range(width)):
            moved = [tuple(r[i] for i in order) for r in a]
            if moved == wanted if ordered else Counter(moved) == wanted:
                return True
    return False


@F.pandas_udf(BooleanType())
def columns_permuted(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Whether some order of at most six columns makes the predicted rows equal the gold ones (X7)."""
    for a, b, ordered in batches:
        yield pd.Series([x is not None and y is not None and _columns_match([list(r) for r in x], [list(r) for r in y], bool(o)) for x, y, o in zip(a, b, ordered, strict=True)])
