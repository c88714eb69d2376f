"""Held-out texts that occur in a training corpus, found with suffix arrays.

The corpus is read in shards of about SHARD_WORDS words (a partition holds one or more). In each shard the suffixes that
start with a word of the held-out texts and have at least the least number of words left are sorted by their words: a
suffix array over the shard, whose order beyond that number isn't needed. Every suffix of every held-out text is then
looked up by binary search, all at once; each hit is extended word by word to its longest verbatim match.

Words are lower-cased, without accents and punctuation, so passages match that differ only in these. Held-out texts are
sent to the shards in blocks of at most BLOCK_WORDS words, each block with a pass of its own, so any number of them
can be searched; hits are gathered in chunks, so a passage that a third of all documents hold stays bounded.
Texts with fewer words than the least, null or empty texts have no match; repeated documents each give their rows;
very long documents are read whole; an empty corpus or held-out table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamis.llm.shingles import word_hashes

LEAST_WORDS = 10
SHARD_WORDS = 1_000_000
BLOCK_WORDS = 4_000_000
CHUNK = 2_000_000


class HeldOut:
    """The words of held-out texts and the suffixes that are long enough."""

    def __init__(self, items: list, texts: list[str | None], owner: list[int], least: int):
        self.items, self.least = items, least
        self.words, text = word_hashes(texts)
        ends = np.searchsorted(text, text, side="right")
        self.left = ends - np.arange(len(text))
        self.starts = np.flatnonzero(self.left >= least)
        self.owner = np.asarray(owner, np.int64)[text] if len(text) else np.zeros(0, np.int64)
        self.field_of = text
        self.vocabulary = np.unique(self.words)


def _packed(words: np.ndarray, starts: np.ndarray, least: int, bits: int) -> list[np.ndarray]:
    """The first words of each suffix as few sortable keys of whole word numbers, of so many bits each."""
    keys = []
    each = 63 // bits
    for at in range(0, least, each):
        key = np.zeros(len(starts), np.int64)
        for i in range(at, min(at + each, least)):
            key = (key << bits) | words[starts + i]
        keys.append(key)
    return keys


def _bound(sorted_keys: list[np.ndarray], wanted: list[np.ndarray], upper: bool) -> np.ndarray:
    """For each wanted suffix, how many sorted ones are less (or not greater): binary searches side by side."""
    n = len(sorted_keys[0])
    low, high = np.zeros(len(wanted[0]), np.int64), np.full(len(wanted[0]), n, np.int64)
    while (open_ := low < high).any():
        mid = (low + high) // 2
        probe = np.minimum(mid, n - 1)
        below = np.zeros(len(low), bool)
        equal = np.ones(len(low), bool)
        for have, want in zip(sorted_keys, wanted, strict=True):
            h = have[probe]
            below |= equal & (h < want)
            equal &= h == want
        right = (below | equal) if upper else below
        low = np.where(open_ & right, mid + 1, low)
        high = np.where(open_ & ~right, mid, high)
    return low


def search_shard(texts: list[str | None], held: HeldOut) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, text of the held-out side, longest match, word of the document, word of the text) of each pair."""
    none = (np.zeros(0, np.int64),) * 5
    least = held.least
    hashes, doc = word_hashes(texts)
    if not len(hashes) or not len(held.starts):
        return none
    # Words are numbered by their place among the held-out words; all others share one number, which no suffix asks for.
    number = np.searchsorted(held.vocabulary, hashes)
    number[number == len(held.vocabulary)] = 0
    words = np.where(held.vocabulary[number] == hashes, number + 1, 0)
    left = np.searchsorted(doc, doc, side="right") - np.arange(len(doc))
    starts = np.flatnonzero((words > 0) & (left >= least))
    if not len(starts):
        return none
    bits = int(len(held.vocabulary)).bit_length()  # the numbers 0 to len(vocabulary) fit
    keys = _packed(words, starts, least, bits)
    order = np.lexsort(keys[::-1])
    starts, keys = starts[order], [k[order] for k in keys]
    own = np.searchsorted(held.vocabulary, held.words) + 1
    wanted = _packed(own, held.starts, least, bits)
    low, high = _bound(keys, wanted, False), _bound(keys, wanted, True)
    hit = np.flatnonzero(high > low)
    best: list[np.ndarray] = []
    at = 0
    while at < len(hit):
        counts = (high - low)[hit[at:]]
        take = max(1, int(np.searchsorted(np.cumsum(counts), CHUNK, side="right")))
        part, counts = hit[at : at + take], counts[:take]
        t = np.repeat(held.starts[part], counts)
        p = starts[np.repeat(low[part] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())]
        # Only where a match can't be extended to the left does a longest match begin.
        inner = (p > 0) & (t > 0)
        longer = np.zeros(len(p), bool)
        longer[inner] = (doc[p[inner] - 1] == doc[p[inner]]) & (held.field_of[t[inner] - 1] == held.field_of[t[inner]]) & (words[p[inner] - 1] == own[t[inner] - 1])
        t, p = t[~longer], p[~longer]
        length = np.full(len(p), least, np.int64)
        alive = np.arange(len(p))
        while len(alive):
            more = (length[alive] < left[p[alive]]) & (length[alive] < held.left[t[alive]])
            alive = alive[more]
            alive = alive[words[p[alive] + length[alive]] == own[t[alive] + length[alive]]]
            length[alive] += 1
        rows = np.stack([doc[p], held.field_of[t], -length, p, t], axis=1)
        rows = rows[np.lexsort(rows.T[::-1])]
        best.append(rows[np.append(True, (np.diff(rows[:, :2], axis=0) != 0).any(axis=1))[: len(rows)]])
        at += take
    if not best:
        return none
    rows = np.concatenate(best)
    rows = rows[np.lexsort(rows.T[::-1])]
    rows = rows[np.append(True, (np.diff(rows[:, :2], axis=0) != 0).any(axis=1))[: len(rows)]]
    first_of_doc = np.searchsorted(doc, rows[:, 0])
    first_of_text = np.searchsorted(held.field_of, rows[:, 1])
    return rows[:, 0], rows[:, 1], -rows[:, 2], rows[:, 3] - first_of_doc, rows[:, 4] - first_of_text


def _searcher(key: str, text: str, held, fields: list[str], item_type: pa.DataType):
    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list = []
        texts: list[str | None] = []
        size = 0

        def shard() -> Iterator[pa.RecordBatch]:
            d, t, length, at, item_at = search_shard(texts, held.value)
            if len(d):
                index = held.value.owner_of_text[t]
                yield pa.RecordBatch.from_arrays(
                    [pa.concat_arrays(keys).take(pa.array(d)), pa.array([held.value.items[i] for i in index], item_type), pa.array([fields[i] for i in t % len(fields)]), pa.array(length, pa.int32()), pa.array(at, pa.int64()), pa.array(item_at, pa.int64())],
                    ["doc", "item", "field", "words", "doc_word", "item_word"],
                )

        for batch in batches:
            keys.append(batch.column(key))
            more = batch.column(text).to_pylist()
            texts += more
            size += sum(len(t) for t in more if t) // 6
            if size > SHARD_WORDS:
                yield from shard()
                keys, texts, size = [], [], 0
        if texts:
            yield from shard()

    return search


def leaked_passages(corpus: DataFrame, key: str, text: str, items: DataFrame, item_key: str, fields: list[str], least: int = LEAST_WORDS) -> DataFrame:
    """(doc, item, field, words, doc_word, item_word): the longest match of each document and item's field."""
    spark = corpus.sparkSession
    kinds = dict(corpus.dtypes) | {"": ""}
    item_kind = dict(items.dtypes)[item_key]
    schema = f"doc {kinds[key]}, item {item_kind}, field string, words int, doc_word bigint, item_word bigint"
    item_type = pa.int64() if item_kind == "bigint" else pa.int32() if item_kind == "int" else pa.string()
    found: list[DataFrame] = []
    rows: list = []

    def block() -> None:
        texts = [r[f] for r in rows for f in fields]
        owner = [i for i in range(len(rows)) for _ in fields]
        held = HeldOut([r[item_key] for r in rows], texts, owner, least)
        held.owner_of_text = np.asarray(owner, np.int64)
        found.append(corpus.select(key, text).mapInArrow(_searcher(key, text, spark.sparkContext.broadcast(held), fields, item_type), schema))

    size = 0
    for r in items.select(item_key, *fields).toLocalIterator():
        rows.append(r)
        size += sum(len(r[f] or "") for f in fields) // 6
        if size > BLOCK_WORDS or len(rows) > 1_000_000:
            block()
            rows, size = [], 0
    if rows:
        block()
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], schema)
