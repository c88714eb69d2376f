"""Near-duplicate records: all pairs whose sets of adjacent words are at least as similar as a threshold.

Records with equal sets are one node, so copies never meet each other in a candidate list. The steps:

1. Each record's set of word pairs is hashed once and kept with its MinHash bytes as a table in the shared folder.
2. A count sketch of all word pairs gives the global order, rarest first. It has about as many counters as there are word
   pairs, at most 2^MOST_BITS, one byte each once merged; a fuller sketch makes lists longer and never loses a link. A
   counter of 1 proves that a word pair occurs in one node only.
3. Each node lists its rarest word pairs as far as the threshold requires: with size n, the n - ceil(tn) + 1 first to
   ask with, the n - ceil(2t/(1+t) n) + 1 first to be found by the larger ones. Word pairs of a single node are left out. Nodes
   meet at a common entry; size and position bounds drop pairs that can't reach the threshold. Word pairs whose counter
   exceeds HOT are counted exactly; those truly more frequent are spread over blocks, so that each task sees a bounded
   part of a list.
4. Candidates are pruned Bayesian: MinHash values are compared eight at a time, and a pair is dropped once the posterior
   probability that its similarity reaches the threshold, from a uniform prior, falls below the tolerance.
5. The rest is verified exactly on the texts, and pairs of nodes are expanded to pairs of records.

Null texts count as empty; records without any word pair have no partner; very long texts are processed whole;
repeated rows with different keys are partners of each other; an empty table gives no pairs. Columns are read by name.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamis.llm.shingles import mix, pair_sets, set_ids, sliced
from tamis.session import materialize, tidy

LEAST_BITS, MOST_BITS = 16, 26
BLOCK_BITS = 16
FAN = 64
HOT = 4096
HASHES, STEP = 64, 8
KEPT = 5  # bytes of each hash kept for the candidates; word pairs that then agree only add candidates
TOLERANCE = 1e-6
_SEEDS = mix(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019)) | np.uint64(1)


def _batch(columns: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names)


def _fields(batch: pa.RecordBatch, names: list[str]) -> list[list]:
    return [batch.column(n).to_pylist() for n in names]


def _sets(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hashes of a batch's sets, the row of each, and the sets' sizes."""
    raw = batch.column("pairs")
    ends = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1].astype(np.int64) if len(raw) else np.zeros(1, np.int64)
    data = raw.buffers()[2]
    kept = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    pairs = np.zeros((len(kept) // width, 8), np.uint8)
    pairs[:, 8 - width :] = kept.reshape(-1, width)
    sizes = np.diff(ends) // width
    return pairs.view(np.uint64).ravel(), np.repeat(np.arange(len(sizes)), sizes), sizes


def _first_of_set(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One record for each distinct set of a batch, none without a word pair."""
    for batch in sliced(batches):
        ids = batch.column("id").to_numpy()
        kept = np.sort(np.unique(ids, return_index=True)[1])
        kept = kept[ids[kept] != 0]
        if len(kept):
            yield batch.take(pa.array(kept))


def _sketch(bits: int):
    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, np.uint32)
        for batch in _first_of_set(batches):
            np.add.at(counts, (_sets(batch, KEPT)[0] >> np.uint64(64 - bits)).astype(np.int64), np.uint32(1))  # a typed one is many times faster
        for block in np.flatnonzero(counts.reshape(-1, 1 << BLOCK_BITS).any(axis=1)):
            yield _batch([pa.array([block], pa.int32()), pa.array([zlib.compress(counts[block << BLOCK_BITS : (block + 1) << BLOCK_BITS].tobytes(), 1)])], ["block", "counts"])

    return count


def _add(last: bool):
    """Sums the parts of each block; at last as one byte a counter."""

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, raw in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                part = np.frombuffer(zlib.decompress(raw), np.uint32)
                sums[block] = np.minimum(sums[block].astype(np.uint64) + part, 0xFFFFFFFF).astype(np.uint32) if block in sums else part
        for block, total in sums.items():
            if last:
                total = np.where(total > 1, np.maximum(2, np.round(6 * np.log2(np.maximum(total, 1)))), total).astype(np.uint8)
            yield _batch([pa.array([block], pa.int32()), pa.array([zlib.compress(total.tobytes(), 1)])], ["block", "counts"])

    return add


def frequency_levels(nodes: DataFrame, bits: int) -> np.ndarray:
    """One byte a counter: 0 and 1 are counts, other levels are six times the logarithm to base 2.

    The tasks' parts are added in a tree of fan-in FAN, so that no task reads one of every other.
    """
    schema = "block int, counts binary"
    parts = nodes.rdd.getNumPartitions()
    merged = nodes.select("id", "pairs").mapInArrow(_sketch(bits), schema)
    while parts > FAN:
        parts = -(-parts // FAN)
        merged = merged.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(parts))).repartition("block", "part").mapInArrow(_add(False), schema)
    merged = merged.repartition("block").mapInArrow(_add(True), schema)
    levels = np.zeros(1 << bits, np.uint8)
    with tidy(nodes.sparkSession):
        for r in merged.toLocalIterator():  # at most 2^(bits - 16) rows, each under 64 KB
            levels[r["block"] << BLOCK_BITS : (r["block"] + 1) << BLOCK_BITS] = np.frombuffer(zlib.decompress(r["counts"]), np.uint8)
    return levels


def _ceil(x: np.ndarray) -> np.ndarray:
    return np.ceil(x - 1e-9).astype(np.int64)


def _hot_counts(levels, bits: int):
    """(key, c): how many sets of a batch hold each word pair whose counter exceeds HOT."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = levels.value
        for batch in _first_of_set(batches):
            pairs = _sets(batch, KEPT)[0]
            some, counts = np.unique(pairs[table[(pairs >> np.uint64(64 - bits)).astype(np.int64)] >= 6 * np.log2(HOT)], return_counts=True)
            if len(some):
                yield _batch([some.view(np.int64), counts.astype(np.int64)], ["key", "c"])

    return count


def _entries(threshold: float, levels, bits: int):
    def entries(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = levels.value
        for batch in _first_of_set(batches):
            pairs, record, sizes = _sets(batch, KEPT)
            ids = batch.column("id").to_numpy()
            level = table[(pairs >> np.uint64(64 - bits)).astype(np.int64)]
            order = np.lexsort((pairs, level, record))
            pairs, level = pairs[order], level[order]
            starts = np.cumsum(sizes) - sizes
            place = np.arange(len(pairs)) - starts[record]
            asks = sizes - _ceil(threshold * sizes) + 1
            keep = (place < asks[record]) & (level != 1)
            record = record[keep]
            yield _batch([pairs[keep].view(np.int64), ids[record], sizes[record].astype(np.int32), place[keep].astype(np.int32)], ["key", "id", "n", "pos"])

    return entries


def _spread(entries: DataFrame, hot: DataFrame) -> DataFrame:
    """Entries of word pairs in c > HOT nodes go to each block that their part of the list shares with another part."""
    parts = F.ceil(F.col("c") / HOT).cast("int")
    joined = entries.join(hot, "key", "left").withColumn("g", F.when(F.col("c") > HOT, parts))
    own = F.pmod(F.shiftrightunsigned("id", 7), F.col("g")).cast("int")
    cells = F.transform(F.sequence(F.lit(0), F.col("g") - 1), lambda other: F.xxhash64("key", F.least(own, other), F.greatest(own, other)))
    keys = F.when(F.col("g").isNull(), F.array("key")).otherwise(cells)
    return joined.select(F.explode(keys).alias("key"), "id", "n", "pos")


def _meet(threshold: float):
    """Candidates from entries sorted by key, size and id; lists are walked by distance, all lists at once."""

    def found(key: np.ndarray, who: np.ndarray, n: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ends = np.searchsorted(key, key, side="right")
        asked = n - _ceil(2 * threshold / (1 + threshold) * n) + 1
        k = np.flatnonzero((pos < asked) & (ends - np.arange(len(key)) > 1))
        left, right, d = [], [], 1
        while len(k := k[ends[k] > k + d]):
            o = k + d
            near = n[k] >= _ceil(threshold * n[o])
            k, o = k[near], o[near]
            need = _ceil(threshold / (1 + threshold) * (n[k] + n[o]))
            ok = (np.minimum(n[k] - pos[k], n[o] - pos[o]) >= need) & (who[k] != who[o])
            left.append(np.minimum(who[k[ok]], who[o[ok]]))
            right.append(np.maximum(who[k[ok]], who[o[ok]]))
            d += 1
        if not left:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        both = np.unique(np.stack([np.concatenate(left), np.concatenate(right)], axis=1), axis=0)
        return both[:, 0], both[:, 1]

    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, size
            rows = np.concatenate(held, axis=1)
            cut = rows.shape[1] if last else int(np.searchsorted(rows[0], rows[0, -1], side="left"))
            if cut:
                a, b = found(*rows[:, :cut])
                if len(a):
                    yield _batch([a, b], ["a", "b"])
            held, size = [rows[:, cut:]], rows.shape[1] - cut

        for batch in batches:
            held.append(np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("key", "id", "n", "pos")]))
            size += batch.num_rows
            if size >= 200_000:
                yield from flush(False)
        if size:
            yield from flush(True)

    return meet


def _nodes(key: str, columns: list[str]):
    def nodes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            pairs, _, sizes = pair_sets(_fields(batch, columns))
            ids = set_ids(pairs, sizes)
            sig = np.zeros((len(sizes), HASHES), np.uint8)
            some = sizes > 0
            ends = np.cumsum(sizes)
            if some.any():
                starts = (ends - sizes)[some]
                for i, seed in enumerate(_SEEDS):
                    sig[some, i] = np.minimum.reduceat((pairs ^ (seed >> np.uint64(3))) * seed, starts) >> np.uint64(24)
            offsets = pa.py_buffer(np.append(0, ends * KEPT).astype(np.int32).tobytes())
            high = np.ascontiguousarray(pairs.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 8 - KEPT :])
            sets = pa.Array.from_buffers(pa.binary(), len(sizes), [None, offsets, pa.py_buffer(high.tobytes())])
            yield _batch([batch.column(key), ids.view(np.int64), pa.array([s.tobytes() for s in sig], pa.binary()), sets], [key, "id", "sig", "pairs"])

    return nodes


def least_matches(threshold: float, tolerance: float = TOLERANCE) -> list[int]:
    """After each STEP of hashes, the fewest matches at which P(similarity >= threshold | matches) >= tolerance."""
    s = (np.arange(4000) + 0.5) / 4000
    p = s + (1 - s) / 256  # equal bytes by chance
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        for m in range(n + 1):
            like = m * np.log(p) + (n - m) * np.log1p(-p)
            like = np.exp(like - like.max())
            if like[s >= threshold].sum() >= tolerance * like.sum():
                out.append(m)
                break
    return out


def _prune(threshold: float, tolerance: float):
    least = least_matches(threshold, tolerance)

    def prune(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, HASHES) for c in ("a_sig", "b_sig"))
            alive = np.arange(len(a))
            matches = np.zeros(len(a), np.int64)
            for step, m in enumerate(least):
                cut = slice(step * STEP, (step + 1) * STEP)
                matches[alive] += (a[alive, cut] == b[alive, cut]).sum(axis=1)
                alive = alive[matches[alive] >= m]
                if not len(alive):
                    break
            if len(alive):
                yield batch.select(["a", "b"]).take(pa.array(alive))

    return prune


def _verify(columns: list[str], threshold: float):
    def verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows = batch.num_rows
            if not rows:
                continue
            texts = [[x for ab in zip(batch.column(f"a_{c}").to_pylist(), batch.column(f"b_{c}").to_pylist(), strict=True) for x in ab] for c in columns]
            pairs, record, sizes = pair_sets(texts)
            # The two sides' sets are disjoint lists of distinct hashes, so a hash seen twice for a candidate is shared.
            side = record // 2
            order = np.lexsort((pairs, side))
            pairs, side = pairs[order], side[order]
            shared = np.bincount(side[1:][(pairs[1:] == pairs[:-1]) & (side[1:] == side[:-1])], minlength=rows)
            union = sizes[0::2] + sizes[1::2] - shared
            ok = (union > 0) & (shared >= _ceil(threshold * union))
            if ok.any():
                yield _batch([batch.column("a").filter(pa.array(ok)), batch.column("b").filter(pa.array(ok)), shared[ok] / union[ok]], ["a", "b", "similarity"])

    return verify


def _renamed(df: DataFrame, key: str, columns: list[str]) -> tuple[DataFrame, list[str]]:
    """The key as rec and the texts as t0, t1 and so on, so that no name of the table can clash with the steps'."""
    names = [f"t{i}" for i in range(len(columns))]
    return df.select(F.col(key).alias("rec"), *(F.col(c).alias(n) for c, n in zip(columns, names, strict=True))), names


def record_nodes(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(rec, id, sig, pairs): each record's key and node, 0 for records without a word pair, its MinHash bytes and its set."""
    d, names = _renamed(df, key, columns)
    return d.mapInArrow(_nodes("rec", names), f"rec {dict(d.dtypes)['rec']}, id bigint, sig binary, pairs binary")


def similar_nodes(df: DataFrame, nodes: DataFrame, key: str, columns: list[str], threshold: float, tolerance: float = TOLERANCE, bits: int | None = None) -> DataFrame:
    """Pairs (a, b, similarity) of nodes, a < b; nodes: a table of record_nodes() of the same records. bits: the sketch's
    size, by default from the data."""
    spark = nodes.sparkSession
    df, columns = _renamed(df, key, columns)
    if bits is None:
        words = nodes.agg(F.sum(F.octet_length("pairs")) / KEPT).first()[0] or 1
        bits = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(max(1, words)))))
    sets = nodes.select("id", "pairs")
    levels = spark.sparkContext.broadcast(frequency_levels(nodes, bits))
    hot = materialize(sets.mapInArrow(_hot_counts(levels, bits), "key bigint, c bigint").groupBy("key").agg(F.sum("c").alias("c")).where(F.col("c") > HOT), "hot")
    entries = _spread(sets.mapInArrow(_entries(threshold, levels, bits), "key bigint, id bigint, n int, pos int"), hot)
    candidates = entries.repartition("key").sortWithinPartitions("key", "n", "id").mapInArrow(_meet(threshold), "a bigint, b bigint").distinct()
    one = nodes.where("id != 0").groupBy("id").agg(F.min(F.struct("rec", "sig")).alias("r")).select("id", "r.rec", "r.sig")
    side = lambda t, c: t.select(F.col("id").alias(c), *(F.col(x).alias(f"{c}_{x}") for x in t.columns if x != "id"))
    signed = one.select("id", "sig")
    both = candidates.join(side(signed, "a"), "a").join(side(signed, "b"), "b")
    left = materialize(both.mapInArrow(_prune(threshold, tolerance), "a bigint, b bigint"), "candidates")
    wanted = left.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    chosen = one.select("id", F.col("rec").alias("_chosen")).join(wanted, "id")
    # texts take less room than sets, so those of the few that are left are read again
    whole = materialize(df.join(chosen, F.col("rec") == F.col("_chosen")).select("id", *columns).dropDuplicates(["id"]), "texts")
    ready = left.join(side(whole, "a"), "a").join(side(whole, "b"), "b")
    return ready.mapInArrow(_verify(columns, threshold), "a bigint, b bigint, similarity double")


def similar_records(df: DataFrame, key: str, columns: list[str], threshold: float) -> DataFrame:
    """Pairs (a, b) of the keys of similar records, a < b, with copies expanded."""
    nodes = materialize(record_nodes(df, key, columns), "nodes")
    members = nodes.where("id != 0").select("rec", "id")
    alike = similar_nodes(df, nodes, key, columns, threshold).select("a", "b")
    one, two = (members.select(F.col("id").alias(n), F.col("rec").alias(f"k{n}")) for n in "ab")
    apart = alike.join(one, "a").join(two, "b").select("ka", "kb")
    crowded = members.groupBy("id").agg(F.count("*").alias("c")).where("c > 1").select("id")
    copies = members.join(crowded, "id")
    same = copies.select("id", F.col("rec").alias("ka")).join(copies.select("id", F.col("rec").alias("kb")), "id").where("ka < kb").select("ka", "kb")
    return apart.unionByName(same).select(F.least("ka", "kb").alias("a"), F.greatest("ka", "kb").alias("b"))
