"""Texts cut before their end, told by a backward character n-gram model and the limits of their fields.

The model counts, over every position of every text, how often the last n characters (ORDERS) are followed by a
boundary: the end of the text, a line's end, or white space after final punctuation. Digits, codes and capitalised words
are shown as classes. Marks that a transfer leaves at the end (an ellipsis, a half character, a closing tag, blanks) are
taken off first, and count as boundaries, so closings like "and so on..." are learned as such. The ends of texts that
occur more than once are not counted, so that copies don't vouch for each other. For the final context of each text the
orders are interpolated from the shortest on, its own end left out, into P(boundary | context), which
gives the log-odds of an end against a continuation.

The threshold depends on language, source and the evidence of the field: whether the text is as long as one of its
source's limits (a length in characters or bytes that far too many of its texts have), and whether the sender announced
more bytes than arrived. The share of cut texts in each such group, smoothed towards the share of all texts with that
evidence, is its prior. Where a text ends in a statement, the statement is checked: an open one is a cut text, a whole one
gains log-odds, since little in its characters tells its end from a pause.

Copies are told by a 128-bit hash of the text. A first pass takes the final contexts of all texts; the counting pass sums
positions by the 64-bit hash of their context, and a groupBy adds them up exactly, however many there are. Bitmaps of the
final contexts only save work there: they are sized from the number of contexts (16 places each, at most 2^MOST_BITS an
order), and what passes one by chance is dropped where counts are joined to final contexts. Null and empty texts are whole; very long texts are read whole; texts fetched again count like
others; an empty table gives no rows. Null languages and sources are groups of their own.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamis.functions.words import plain
from tamis.llm.statements import open_state
from tamis.session import materialize, tidy

ORDERS = (2, 4, 7, 11, 16, 24)
MOST_BITS = 29
SLICE = 1 << 16  # places of a bitmap made by one task
HELD = 1 << 20
PULL = 6.0
LEAST_AT_LIMIT, SHARE_AT_LIMIT, NEAR = 8, 0.01, 3
_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)
PIECE = 1 << 20

_CODE = re.compile(r"\b[A-Z]{2,}-[0-9]+|\b[A-Z]{3}-(?=\W|$)")
_NUMBER = re.compile(r"[0-9]+")
_NAME = re.compile(r"(?<=[^.!?\n] )[A-ZÀ-Þ][a-zà-ÿ'-]+(?: [A-ZÀ-Þ][a-zà-ÿ'-]+)*")
_LEFT = re.compile(r"(?:\s+|</?\w+>?|�+|\[?(?:\.{3,}|…)\]?|(?<=\s)\[\.{0,2}|&[a-z]{0,5};?|\\(?:u[0-9a-fA-F]{0,4})?)+$")
_MARKS = re.compile(r"\[?(?:\.{3,}|…)\]?|</?\w+>|�")


def shown(text: str) -> str:
    """The text as the model sees it."""
    text = _NUMBER.sub("0", _CODE.sub("K", text))
    text = _NAME.sub("N", text)
    if "..." in text or "…" in text or "<" in text or "�" in text:
        text = _MARKS.sub("\3", text)
    return plain(text).replace("\r", "\n")


def _may_be_left(text: str) -> bool:
    """Whether anything of _LEFT can stand at the end: told by the last characters, without a search."""
    last = text[-1]
    if last == ".":
        return text.endswith(("...", "[.", "[.."))
    if last.isspace() or last in ">\ufffd]\u2026[;":
        return True
    tail = text[-200:]
    return "<" in tail or "&" in tail or "\\" in tail


def stripped(text: str) -> str:
    """The text without what a transfer leaves at its end."""
    while text and _may_be_left(text) and (m := _LEFT.search(text, max(0, len(text) - 200))):
        text = text[: m.start()]
    return text


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base & (2**64 - 1), np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POW, _INV = _powers(PIECE + 8192, _BASE), _powers(PIECE + 8192, _INVERSE)


def _prefix_sums(buf: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(buf * _POW[: len(buf)], dtype=np.uint64)])


def _window_hashes(sums: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """For each position, a hash of the n bytes that end there."""
    h = (sums[at + 1] - sums[np.maximum(0, at + 1 - n)]) * _INV[at]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def _mark(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def _marked(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    places = _mark(h, len(bitmap).bit_length() + 2)
    return (bitmap[places >> 3] >> (7 - (places & 7)).astype(np.uint8)) & 1 == 1


_PAD = "\2" * max(ORDERS)


def _count_piece(buf: np.ndarray, filters: list[np.ndarray]) -> list[np.ndarray]:
    """For each order, rows of hash, positions and boundaries of the contexts that pass."""
    after = np.append(buf[1:], np.uint8(2))
    final = (buf == 46) | (buf == 33) | (buf == 63)
    bound = (after == 10) | (after == 2) | (after == 3) | (final & (after == 32))
    at = np.flatnonzero((buf > 4) & (buf != 10))
    sums = _prefix_sums(buf)
    out = []
    for o, n in enumerate(ORDERS):
        h = _window_hashes(sums, at, n)
        keep = _marked(filters[o], h)  # a longer context ends a text only if the shorter one does
        at, h = at[keep], h[keep]
        seen, counts = np.unique(h, return_counts=True)
        ends, some = np.unique(h[bound[at]], return_counts=True)
        bounds = np.zeros_like(counts)
        bounds[np.searchsorted(seen, ends)] = some
        out.append(np.stack([seen.view(np.int64), counts, bounds]))
    return out


def _summed(parts: list[np.ndarray]) -> np.ndarray:
    """Rows of hash, positions and boundaries, one column a hash."""
    rows = np.concatenate(parts, axis=1)
    if not rows.shape[1]:
        return rows
    rows = rows[:, np.argsort(rows[0], kind="stable")]
    first = np.flatnonzero(np.append(True, rows[0, 1:] != rows[0, :-1]))
    return np.stack([rows[0, first], np.add.reduceat(rows[1], first), np.add.reduceat(rows[2], first)])


def _pieces(texts: Iterable[tuple[str, bool]]) -> Iterator[np.ndarray]:
    """Encoded texts in pieces of bounded length; the last position of a text is left out unless it is the only copy."""
    held: list[bytes] = []
    size = 0
    for t, single in texts:
        seen = shown(t)
        raw = (_PAD + (seen if single else seen[:-1] + "\4")).encode("ascii", "replace")
        while len(raw) > PIECE:
            # the next piece starts with the context of its first position, shown as pad so that it isn't counted again
            yield np.frombuffer(raw[:PIECE], np.uint8)
            raw = _PAD.encode() + raw[PIECE:]
        if size + len(raw) > PIECE and held:
            yield np.frombuffer(b"".join(held), np.uint8)
            held, size = [], 0
        held.append(raw)
        size += len(raw)
    if held:
        yield np.frombuffer(b"".join(held), np.uint8)


def _final_hashes(texts: list[str]) -> list[np.ndarray]:
    """For each order, the hash of the final context of each text."""
    width = max(ORDERS)
    finals = [(_PAD + shown(stripped(t)[-400:]))[-width:].encode("ascii", "replace") for t in texts]
    out: list[list[np.ndarray]] = [[] for _ in ORDERS]
    for i in range(0, len(texts), 4096):
        buf = np.frombuffer(b"".join(finals[i : i + 4096]), np.uint8)
        sums, at = _prefix_sums(buf), np.arange(width - 1, len(buf), width)
        for o, n in enumerate(ORDERS):
            out[o].append(_window_hashes(sums, at, n))
    return [np.concatenate(x) if x else np.zeros(0, np.uint64) for x in out]


_NAMES = [f"h{n}" for n in ORDERS]
_LAST = _NAMES[-1]  # the longest context tells all shorter ones


def _slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One bitmap of SLICE places for each order and slice, from rows of order, slice and place sorted by the first two."""
    now: tuple[int, int] | None = None
    bits = np.zeros(SLICE >> 3, np.uint8)

    def over() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int32()), pa.array([now[1]], pa.int64()), pa.array([zlib.compress(bits.tobytes(), 1)])], ["o", "slice", "marks"])

    for batch in batches:
        o, at, place = (batch.column(c).to_numpy() for c in ("o", "slice", "place"))
        cuts = np.flatnonzero((o[1:] != o[:-1]) | (at[1:] != at[:-1])) + 1
        for i, j in zip(np.append(0, cuts), np.append(cuts, len(o)), strict=True):
            if i == j:
                continue
            if now != (key := (int(o[i]), int(at[i]))):
                if now is not None:
                    yield over()
                now = key
                bits[:] = 0
            p = place[i:j]
            np.bitwise_or.at(bits, p >> 3, np.uint8(128) >> (p & 7).astype(np.uint8))
    if now is not None:
        yield over()


def _learn(filters):
    """Partial counts of the contexts; columns text and copied."""

    def rows(o: int, sums: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(sums.shape[1], o, np.int32)), *map(pa.array, sums)], ["o", "h", "n", "b"])

    def learn(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[] for _ in ORDERS]
        texts = ((stripped(t), not c) for batch in batches for t, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if t)
        for piece in _pieces(texts):
            for o, part in enumerate(_count_piece(piece, filters.value)):
                held[o].append(part)
                if sum(x.shape[1] for x in held[o]) > HELD:
                    held[o] = [_summed(held[o])]
                    if held[o][0].shape[1] > HELD // 2:
                        yield rows(o, held[o].pop())
        for o, parts in enumerate(held):
            if parts:
                yield rows(o, _summed(parts))

    return learn


def copied_texts(df: DataFrame, text: str) -> DataFrame:
    """(hash, copied): the 128-bit hashes of the texts that occur more than once."""
    return df.select(F.unhex(F.md5(text)).alias("hash")).where("hash IS NOT NULL").groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash", F.lit(True).alias("copied"))


def context_counts(texts: DataFrame, contexts: DataFrame) -> DataFrame:
    """(o, h, n, b): positions and boundaries seen after each context of each order; some that end no text are among them.

    texts: text, copied; contexts: the hashes of the final contexts, one column an order.
    """
    spark = texts.sparkSession
    about = contexts.agg(*(F.approx_count_distinct(c) for c in _NAMES)).first()  # these only size the bitmaps
    bits = [min(MOST_BITS, max(SLICE.bit_length() - 1, math.ceil(math.log2(16 * max(1, n))))) for n in about]
    filters = [np.zeros(1 << (n - 3), np.uint8) for n in bits]
    # Every slice of a bitmap is made by one task from its own places, however many tasks hold contexts.
    places = contexts.select(F.posexplode(F.array(*(F.shiftrightunsigned(c, 64 - n) for c, n in zip(_NAMES, bits, strict=True)))).alias("o", "p"))
    rows = places.select("o", F.floor(F.col("p") / SLICE).alias("slice"), (F.col("p") % SLICE).alias("place"))
    made = rows.repartition("o", "slice").sortWithinPartitions("o", "slice").mapInArrow(_slices, "o int, slice bigint, marks binary")
    with tidy(spark):
        for r in made.toLocalIterator():
            filters[r["o"]][r["slice"] * (SLICE >> 3) : (r["slice"] + 1) * (SLICE >> 3)] = np.frombuffer(zlib.decompress(r["marks"]), np.uint8)
    known = spark.sparkContext.broadcast(filters)
    return texts.select("text", "copied").mapInArrow(_learn(known), "o int, h bigint, n bigint, b bigint").groupBy("o", "h").agg(F.sum("n").alias("n"), F.sum("b").alias("b"))


def _odds(own: int) -> Column:
    """The log-odds of an end against a continuation, `own` ends left out; columns n0, b0, n1, ..."""
    p: Column = F.lit(0.02)
    for o in range(len(ORDERS)):
        counts = F.greatest(F.lit(0), F.col(f"n{o}") - own)
        p = (F.least(F.greatest(F.lit(0), F.col(f"b{o}") - own), counts) + PULL * p) / (counts + PULL)
    p = F.least(F.lit(1 - 1e-6), F.greatest(F.lit(1e-6), p))
    return F.log(p / (1 - p))


def end_odds(texts: DataFrame, contexts: DataFrame) -> DataFrame:
    """The log-odds after each final context, for texts whose own end is counted (odds_own) and for copies (odds_all)."""
    pairs = contexts.select(_LAST, F.posexplode(F.array(*_NAMES)).alias("o", "h"))
    at = lambda c, o: F.coalesce(F.sum(F.when(F.col("o") == o, F.col(c))), F.lit(0))
    sums = pairs.join(context_counts(texts, contexts), ["o", "h"], "left").groupBy(_LAST).agg(*(at(c, o).alias(f"{c}{o}") for o in range(len(ORDERS)) for c in "nb"))
    return sums.select(_LAST, _odds(1).alias("odds_own"), _odds(0).alias("odds_all"))


_STATEMENT = re.compile(r"(?is)\bselect\b.*")


def statement_end(text: str) -> str:
    """'open' or 'whole' if the text's last paragraph is a statement, 'closed' if it is marked as ended, else ''."""
    last = stripped(text).rpartition("\n\n")[2]
    m = _STATEMENT.search(last)
    before = last[: m.start()].rstrip() if m else ""
    if m is None or (before and not before.lower().endswith((":", "`", "(", "```sql"))):
        return ""
    sql = m[0].rstrip()
    if sql.endswith("```"):
        return "closed"
    if "```" in before:
        return "open"
    state = open_state(sql, frozenset(), frozenset())
    if state == "fromend":  # a table may end a statement, or stand before its conditions
        return "closed" if sql.endswith(";") else ""
    return "open" if state not in ("whole", "number") else "closed" if sql.endswith(";") else "whole"


def _ends(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The statements at the ends and the hashes of the final contexts instead of the texts."""
    for batch in batches:
        texts = batch.column("text").to_pylist()
        some = np.array([bool(t and t.strip()) for t in texts], bool)
        hashes = []
        for h in _final_hashes([t for t, s in zip(texts, some, strict=True) if s]):
            column = np.zeros(len(texts), np.int64)
            column[some] = h.view(np.int64)
            hashes.append(pa.array(column, mask=~some))
        rest = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array([statement_end(t) if t else "" for t in texts], pa.string()), *hashes], [*rest, "statement", *_NAMES])


def scored_texts(df: DataFrame, key: str, text: str, source: str, lang: str, announced: str) -> DataFrame:
    """(key, source, lang, n_chars, n_bytes, more, end_odds, statement) of every text."""
    code = F.regexp_extract(F.lower(F.trim(F.coalesce(lang, F.lit("")))), "^[a-z]{2}", 0)
    used = df.select(
        F.col(key), F.coalesce(source, F.lit("")).alias("source"), code.alias("lang"), F.length(text).alias("n_chars"), F.octet_length(text).alias("n_bytes"),
        F.coalesce((F.col(announced) > F.octet_length(text)).cast("int"), F.lit(-1)).alias("more"), F.col(text).alias("text"), F.unhex(F.md5(text)).alias("hash"),
    )
    told = used.join(materialize(copied_texts(df, text), "copied"), "hash", "left").drop("hash").withColumn("copied", F.coalesce("copied", F.lit(False)))
    hashes = ", ".join(f"{c} bigint" for c in _NAMES)
    ends = materialize(told.mapInArrow(_ends, f"{key} {dict(df.dtypes)[key]}, source string, lang string, n_chars int, n_bytes int, more int, copied boolean, statement string, {hashes}"), "ends")
    odds = end_odds(told, materialize(ends.select(*_NAMES).where(F.col(_LAST).isNotNull()).distinct(), "contexts"))
    found = F.when(F.col(_LAST).isNull(), 14.0).when(F.col("copied"), F.col("odds_all")).otherwise(F.col("odds_own"))
    return ends.join(odds, _LAST, "left").select(key, "source", "lang", "n_chars", "n_bytes", "more", found.alias("end_odds"), "statement")


def _limits(scored: DataFrame) -> DataFrame:
    """(source, unit, length) at or just under a limit of the source."""
    lengths = scored.select("source", F.explode(F.array(F.struct(F.lit("c").alias("unit"), F.col("n_chars").alias("length")), F.struct(F.lit("b").alias("unit"), F.col("n_bytes").alias("length")))).alias("l")).groupBy("source", "l.unit", "l.length").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("source", "unit"))
    peaks = lengths.withColumn("total", total).where((F.col("n") >= LEAST_AT_LIMIT) & (F.col("n") >= SHARE_AT_LIMIT * F.col("total")))
    return peaks.select("source", "unit", F.explode(F.sequence(F.col("length") - NEAR, F.col("length"))).alias("length")).distinct()


def cut_texts(df: DataFrame, key: str, text: str, source: str, lang: str, announced: str) -> DataFrame:
    """(key, source, cut) of every text."""
    scored = materialize(scored_texts(df, key, text, source, lang, announced), "scored")
    limits = materialize(_limits(scored), "limits")
    at = lambda unit, column: limits.where(F.col("unit") == unit).select("source", F.col("length").alias(column), F.lit(True).alias(f"at_{unit}"))
    told = scored.join(at("c", "n_chars"), ["source", "n_chars"], "left").join(at("b", "n_bytes"), ["source", "n_bytes"], "left")
    full = F.coalesce("at_c", "at_b", F.lit(False))
    odds = (
        F.when(F.col("statement") == "open", F.least("end_odds", F.lit(-9.0)))
        .when(F.col("statement") == "closed", F.col("end_odds") + 5)
        .when((F.col("statement") == "whole") & ~full, F.col("end_odds") + 8)
        .otherwise(F.col("end_odds"))
    )
    told = told.select(key, "source", "lang", full.alias("full"), "more", odds.alias("odds"))
    clear = F.avg((F.col("odds") < -4).cast("double"))
    overall = told.groupBy("full", "more").agg(clear.alias("usual"))
    groups = told.groupBy("lang", "source", "full", "more").agg(F.count("*").alias("n"), F.sum((F.col("odds") < -4).cast("int")).alias("c")).join(overall, ["full", "more"])
    prior = F.greatest(F.lit(0.002), F.least(F.lit(0.98), (F.col("c") + 20 * F.col("usual")) / (F.col("n") + 20)))
    limit = groups.select("lang", "source", "full", "more", (-2.5 + 0.5 * F.log(prior / (1 - prior))).alias("limit"))
    return told.join(limit, ["lang", "source", "full", "more"]).select(key, "source", (F.col("odds") < F.col("limit")).alias("cut"))
