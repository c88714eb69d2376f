"""Word hashes and sets of adjacent words, computed over whole Arrow batches with numpy.

A word is hashed as a polynomial of its bytes, mixed to 64 bits; the hashes are the same on every machine.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa

from tamis.functions.words import plain

_MULT = np.uint64(0x9E3779B97F4A7C15)
_CLASS = np.zeros(256, np.uint8)
_CLASS[np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789", np.uint8)] = 1
_POWERS = np.ones(4096, np.uint64)
_POWERS[1:] = np.multiply.accumulate(np.full(4095, 0xD1342543DE82EF95, np.uint64))


def sliced(batches: Iterable[pa.RecordBatch], most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about at most so many bytes, since numpy needs tens of bytes a character."""
    for batch in batches:
        parts = max(1, min(batch.num_rows, -(-batch.nbytes // most)))
        step = -(-batch.num_rows // parts)
        for i in range(0, batch.num_rows, max(1, step)):
            yield batch.slice(i, step)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words in order, and the index of each word's text."""
    if not len(texts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    whole = "\1".join(t or "" for t in texts) + "\1"
    if whole.count("\1") != len(texts):  # the mark occurs in a text, where it separates words
        whole = "\1".join((t or "").replace("\1", " ") for t in texts) + "\1"
    buf = np.frombuffer(plain(whole).encode("ascii", "replace"), np.uint8)
    inside = _CLASS[buf]
    starts = np.flatnonzero(np.diff(inside, prepend=np.uint8(0)) == 1)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(inside)
    lengths_before = np.cumsum(inside, dtype=np.int64)[starts] - 1  # word bytes before each word
    place = np.arange(len(at)) - np.repeat(lengths_before, np.diff(np.append(lengths_before, len(at))))
    h = np.add.reduceat(buf[at].astype(np.uint64) * _POWERS[place & 4095], lengths_before)
    n = np.diff(np.append(lengths_before, len(at))).astype(np.uint64)
    return mix(h + n * _MULT), np.searchsorted(np.flatnonzero(buf == 1), starts, side="right")


def pair_sets(fields: Sequence[Sequence[str | None]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The set of hashed pairs of adjacent words of each record, over several fields, no pair across fields.

    Returns the hashes, sorted within each record, the record of each, and the records' set sizes.
    """
    rows, width = len(fields[0]), len(fields)
    h, text = word_hashes([f[i] for i in range(rows) for f in fields])
    both = text[1:] == text[:-1]
    pairs = mix(h[:-1] * np.uint64(3) + mix(h[1:] + _MULT))[both]
    record = text[:-1][both] // width
    order = np.lexsort((pairs, record))
    pairs, record = pairs[order], record[order]
    first = np.ones(len(pairs), bool)
    first[1:] = (pairs[1:] != pairs[:-1]) | (record[1:] != record[:-1])
    pairs, record = pairs[first], record[first]
    return pairs, record, np.bincount(record, minlength=rows).astype(np.int64)


def set_ids(pairs: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A 64-bit name of each record's set, whatever its order; 0 for the empty set."""
    out = np.zeros(len(sizes), np.uint64)
    some = sizes > 0
    if some.any():
        starts = (np.cumsum(sizes) - sizes)[some]
        out[some] = mix(np.add.reduceat(mix(pairs ^ _MULT), starts) + sizes[some].astype(np.uint64) * _MULT) | np.uint64(1)
    return out
