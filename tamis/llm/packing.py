"""Containers of fixed capacity filled with whole texts, sized in tokens of a public tokenizer.

Texts larger than the capacity are split into pieces of the capacity and a rest; no other text is split. The pieces are
dealt by hash to blocks of about BLOCK pieces. Each block starts from a best fit of the sizes in descending order and is
improved by local search: a piece moves from an emptier to a fuller bin, or one or two pieces change places with one,
whenever that increases the sum of squared fills, until bins become empty or nothing helps. Bins still underfull in all
blocks are dissolved and packed again in fewer blocks, round by round, down to a single block; each round handles a
small part of the one before, so no task ever holds more than a block. Rounds end early once one lessens the pieces by less
than a part SHRINK: then pieces fill no bins but their own, and what is left stays in the bins it has. The search in a
block ends when no step helps, or after PASSES. Both are parameters; every piece is placed whatever they are.

Null and empty texts have size 0 and share the first bin of their block; repeated texts and ties are placed by key;
an empty table gives no rows. The tokenizer file is a parameter (a .tiktoken ranks file); only key and text are read.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamis.session import materialize

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BLOCK = 4096
FULL = 0.995
PASSES = 40
SHRINK = 0.8

_encoders: dict = {}


def encoder(path: str):
    """The tokenizer of a ranks file, loaded once in a process."""
    if path not in _encoders:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def _measure(key: str, text: str, path: str, capacity: int):
    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = encoder(path).encode_ordinary
        for batch in batches:
            sizes = np.array([len(count(t)) if t else 0 for t in batch.column(text).to_pylist()], np.int64)
            pieces = np.maximum(1, -(-sizes // capacity))
            row = np.repeat(np.arange(len(sizes)), pieces)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            first = piece * capacity
            yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(first), pa.array(np.minimum(capacity, sizes[row] - first))], ["key", "piece", "first_token", "tokens"])

    return measure


def measured(df: DataFrame, key: str, text: str, capacity: int, path: str = TOKENIZER) -> DataFrame:
    """(key, piece, first_token, tokens) of every piece."""
    return df.select(key, text).mapInArrow(_measure(key, text, path, capacity), f"key {dict(df.dtypes)[key]}, piece int, first_token bigint, tokens bigint")


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of item numbers: the largest first, each into the fullest bin that has room."""
    bins: list[list[int]] = []
    room: list[tuple[int, int]] = []  # (free, bin), sorted
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        at = bisect_left(room, (size, -1))
        if at == len(room):
            bins.append([i])
            free, b = capacity - size, len(bins) - 1
        else:
            free, b = room.pop(at)
            bins[b].append(i)
            free -= size
        insort(room, (free, b))
    return bins


def improve(bins: list[list[int]], sizes: np.ndarray, capacity: int, passes: int = PASSES) -> list[list[int]]:
    """Local search over the underfull bins; each accepted step increases the sum of squared fills."""
    size, bins = sizes.tolist(), list(bins)
    fill = [sum(size[i] for i in b) for b in bins]
    for _ in range(passes):
        under = sorted((b for b in range(len(bins)) if bins[b] and fill[b] < FULL * capacity), key=lambda b: fill[b])
        changed = False
        for n, a in enumerate(under):
            for b in reversed(under[n + 1 :]):
                while bins[a] and fill[b] >= fill[a] and (step := _step(bins[a], bins[b], size, capacity - fill[b])):
                    out, back = step
                    gain = sum(size[i] for i in out) - sum(size[i] for i in back)
                    bins[a] = [i for i in bins[a] if i not in out] + back
                    bins[b] = [i for i in bins[b] if i not in back] + out
                    fill[a] -= gain
                    fill[b] += gain
                    changed = True
                if not bins[a]:
                    break
        if not changed:
            break
    return [b for b in bins if b]


def _step(source: list[int], target: list[int], size: list[int], free: int) -> tuple[list[int], list[int]] | None:
    """The move, one-for-one or two-for-one exchange that fills the target most within its free space."""
    if free <= 0:
        return None
    best, step = 0, None
    for i in source:
        if best < size[i] <= free:
            best, step = size[i], ([i], [])
    if best == free:
        return step
    back = sorted((size[j], j) for j in target)
    give = [([i], size[i]) for i in source] + [([i, j], size[i] + size[j]) for n, i in enumerate(source) for j in source[n + 1 :]]
    for out, s in give:
        # the smallest returned piece that leaves the gain within the free space
        at = bisect_left(back, (s - free, -1))
        if at < len(back) and best < s - back[at][0] <= free:
            best, step = s - back[at][0], (out, [back[at][1]])
    return step


def pack(sizes: np.ndarray, capacity: int, passes: int = PASSES) -> list[list[int]]:
    some = np.flatnonzero(sizes > 0)
    bins = improve(best_fit(sizes[some], capacity), sizes[some], capacity, passes)
    bins = [[int(some[i]) for i in b] for b in bins]
    nothing = np.flatnonzero(sizes == 0).tolist()
    if nothing and bins:
        bins[0] += nothing
    elif nothing:
        bins = [nothing]
    return bins


def _packer(capacity: int, round_: int, passes: int):
    def packer(pdf):
        pdf = pdf.sort_values(["key", "piece"], ignore_index=True)
        bins = pack(pdf["tokens"].to_numpy(), capacity, passes)
        number = np.empty(len(pdf), np.int64)
        filled = np.empty(len(pdf), np.int64)
        tokens = pdf["tokens"].to_numpy()
        for n, b in enumerate(bins):
            number[b] = n
            filled[b] = tokens[b].sum()
        block = int(pdf["block"].iloc[0])
        pdf["bin_id"] = [f"{round_}-{block}-{n}" for n in number]
        pdf["filled"] = filled
        return pdf[["key", "piece", "first_token", "tokens", "bin_id", "filled"]]

    return packer


def packed(df: DataFrame, key: str, text: str, capacity: int, path: str = TOKENIZER, block: int = BLOCK, passes: int = PASSES, shrink: float = SHRINK) -> DataFrame:
    """(key, piece, first_token, tokens, bin_id) of every piece."""
    left = materialize(measured(df, key, text, capacity, path), "sizes")
    done: DataFrame | None = None
    round_, before = 0, None
    while True:
        n = left.count()
        blocks = max(1, -(-n // block))
        dealt = left.withColumn("block", F.pmod(F.xxhash64("key", "piece", F.lit(round_)), F.lit(blocks)).cast("int"))
        schema = ", ".join(f"{c} {t}" for c, t in left.dtypes) + ", bin_id string, filled bigint"
        result = materialize(dealt.groupBy("block").applyInPandas(_packer(capacity, round_, passes), schema), "packed")
        last = blocks == 1 or (before is not None and n > shrink * before)  # or dissolving no longer lessens the pieces
        settled = result if last else result.where(F.col("filled") >= FULL * capacity)
        settled = settled.drop("filled")
        done = settled if done is None else done.unionByName(settled)
        if last:
            return done
        left = result.where(F.col("filled") < FULL * capacity).drop("filled", "bin_id")
        round_, before = round_ + 1, n
