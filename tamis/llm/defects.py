"""Broken prompt and response pairs: each response's clauses are tagged by a conditional random field, and the
coverage of the tags gives the pair's defect.

The field is trained at every use on a bounded sample of the table's own records (TRAIN_ROWS, chosen by hash order). Its
statements, taken as they are, are answers; cut at hash-chosen characters they are unfinished, wherever the cut falls.
Refusals, accounts in words, other formal or translated languages, copies of the question and placeholders are made for
MADE_ROWS of them from the parts in wording.py, which combine freely. Which statement is open, which words refuse and which
are a placeholder is left to the field. Everything else covers all rows: every record is tagged.

Defects: 'empty' (no clause, or placeholders only), 'refusal', 'copy', 'language', 'truncated'. A response
with a whole statement over tables is no case, whatever its comments say. Null responses are empty. Null questions or
schemas only lessen the features. Very long texts are read whole; repeated rows each give their row; an empty table
gives no rows. If the sample holds no usable statement, a fixed example statement stands for it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamis.functions.words import plain
from tamis.llm.clauses import LABELS, Features, clauses, unwrap, without_comments
from tamis.llm.crf import ChainField, Sequences
from tamis.llm.statements import TOKENS
from tamis.llm.wording import ECHOES, FORMAL, PROSE, REFUSALS, TONGUES, VOID

TRAIN_ROWS = 900
MADE_ROWS = 200
CUTS = 4
CUT_WEIGHT = 0.5
LEAST_SEEN = 3
DOUBT = 0.1
ROUNDS = 90
ANSWER, REFUSAL, ECHO, FOREIGN, UNFINISHED, VOID_ = range(6)
DEFECTS = {REFUSAL: "refusal", ECHO: "copy", FOREIGN: "language", UNFINISHED: "truncated", VOID_: "empty"}

_SPARE = ("Donne a de t où b dépasse 10 ?", "SELECT a FROM t WHERE b > 10", "CREATE TABLE t (a TEXT, b INTEGER)")
_SQL_KEYS = re.compile(r"(?i)\b(" + "|".join(TONGUES[0]) + r")\b")


def _pick(choices: Sequence, h: int, turn: int):
    return choices[crc32(f"{h}:{turn}".encode()) % len(choices)]


def _said(families: list[tuple[list[str], ...]], h: int, turn: int, fill: dict[str, str]) -> str:
    parts = _pick(families[:2] if h & 1 else families, h, turn)
    return "".join(_pick(part, h, turn + i + 1) for i, part in enumerate(parts)).format(**fill)


def _made(question: str, sql: str, schema: str, h: int) -> Iterator[tuple[str, int]]:
    """Responses that answer nothing, each with the label of its clauses."""
    names = [w for w in dict.fromkeys(re.findall(r"\w+", plain(schema))) if len(w) > 3] or ["valeur"]
    values = re.findall(r"'((?:[^']|'')+)'|\b(\d+)\b", sql) or [("x", "1")]
    fill = {"t": _pick(names, h, 1), "c": _pick(names, h, 2), "d": _pick(names, h, 3), "v": "".join(_pick(values, h, 4)), "n": str(h % 90000)}
    refusal = _said(REFUSALS, h, 10, fill)
    refusal = refusal[:1].upper() + refusal[1:] + _pick(["", ".", " !", "."], h, 15)
    for i in range(100, 600, 100):
        yield _said(REFUSALS, h + i, i, fill), REFUSAL
    yield _pick([refusal, refusal, f"-- {refusal}", f"/* {refusal} */\nSELECT NULL", "SELECT '" + refusal.replace("'", "''") + "'"], h, 16), REFUSAL
    for i in (20, 120, 220, 320):
        yield _said(PROSE, h + i, i, fill), FOREIGN
    yield _pick(FORMAL, h, 30).format(**fill), FOREIGN
    tongue = _pick(TONGUES, h, 40)
    kept = {k for i, k in enumerate(tongue) if i > 4 and (h >> i) & 1}  # a translation may keep some of SQL's words
    translated = _SQL_KEYS.sub(lambda m: m[1] if m[1].lower() in kept else tongue.get(" ".join(m[1].lower().split()), m[1]), sql)
    yield translated.lower() if h % 7 == 0 else translated, FOREIGN
    given_back = lambda q, turn: _pick(ECHOES, h, turn).format(q=q, s=q.replace("'", "''"), l=q.lower(), u=q.upper(), p=plain(q))
    yield given_back(question, 50), ECHO
    yield given_back(question, 51), ECHO
    void = _pick(VOID, h, 60)
    yield _pick(["{v}", "-- {v}", "/* {v} */", "{v}.", "({v})"], h, 61).format(v=void), VOID_


def _cuts(sql: str, h: int) -> Iterator[str]:
    """The statement cut CUTS times, after hash-chosen characters and tokens in turn, with what a transfer may leave."""
    tokens = [m.end() for m in TOKENS.finditer(sql)][1:-1]
    for i in range(CUTS):
        turn = crc32(f"{h}:cut:{i}".encode())
        at = tokens[turn % len(tokens)] if i % 2 and tokens else 7 + turn % max(1, len(sql) - 7)
        if at < len(sql):
            yield sql[:at].rstrip() + _pick(["", "", "", "", "...", " [...]", "…", " <cut>"], h, 70 + i)


def train(rows: list[tuple[str | None, str | None, str | None]], made_rows: int = MADE_ROWS) -> tuple[ChainField, Features]:
    """rows: (question, response, schema)."""
    features = Features()
    seen: Counter = Counter()  # sequences of features and labels; many statements share theirs

    def add(response: str, question: str, schema: str, label: int) -> None:
        found = clauses(unwrap(response), question, schema)
        if not found:
            return
        last = len(found) - 1
        tags = tuple(ANSWER if (label == REFUSAL and statement) or (label == UNFINISHED and i < last) else label for i, (_, _, statement, _) in enumerate(found))
        seen[tuple(tuple(features(names)) for names, *_ in found), tags] += 1

    made = 0
    for question, response, schema in [*rows, _SPARE]:
        question, response, schema = question or "", response or "", schema or ""
        sql = without_comments(unwrap(response))[0].strip().rstrip(";").strip()
        if not re.match(r"(?is)(?:select|with)\b.*\bfrom\b", sql) or len(question) < 5:
            continue
        h = crc32(response.encode())
        add(response, question, schema, ANSWER)
        for cut in _cuts(sql, h):
            add(cut, question, schema, UNFINISHED)
        if made < made_rows:
            made += 1
            for response_, label in _made(question, sql, schema, h):
                add(response_, question, schema, label)
    counts = Counter(f for (items, _), n in seen.items() for names in items for f in names for _ in range(n))
    known = [n for n, i in features.numbers.items() if counts[i] >= LEAST_SEEN]
    number = {features.numbers[n]: i for i, n in enumerate(known)}
    kept: Counter = Counter()
    for (items, tags), n in seen.items():
        kept[tuple(tuple(number[f] for f in names if f in number) for names in items), tags] += n * (CUT_WEIGHT if tags[-1] == UNFINISHED else 1)

    # What a text says tells nothing of whether it repeats the question.
    allowed = np.ones((len(known), len(LABELS)))
    allowed[[i for i, n in enumerate(known) if n.startswith(("w=", "4=", "2="))], ECHO] = 0

    def fitted(field: ChainField, of: list, rounds: int) -> ChainField:
        return field.fit(Sequences([x for x, _ in of]), np.array([t for _, tags in of for t in tags]), np.array([kept[x] for x in of], float), rounds, allowed=allowed)

    field = fitted(ChainField(len(known), len(LABELS)), list(kept), ROUNDS // 2)
    # The sample holds broken responses too: what the field itself is sure to be no answer is none to learn from.
    answers = [x for x in kept if set(x[1]) == {ANSWER}]
    likely = field.likelihoods(Sequences([x for x, _ in answers]), ANSWER)
    starts = np.cumsum([0, *(len(t) for _, t in answers)])[:-1]
    doubted = {x for x, p in zip(answers, np.minimum.reduceat(likely, starts) if answers else [], strict=True) if p < DOUBT}
    field = fitted(field, [x for x in kept if x not in doubted], ROUNDS // 2)
    return field, Features(known)


def _tagger(key: str, question: str, response: str, schema: str, model):
    def tag(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, moves, names = model.value
        field = ChainField(*weights.shape)
        field.weights, field.moves = weights, moves
        features = Features(names)
        for batch in batches:
            texts = [unwrap(t) for t in batch.column(response).to_pylist()]
            found = [clauses(t, q, s) for t, q, s in zip(texts, batch.column(question).to_pylist(), batch.column(schema).to_pylist(), strict=True)]
            tags = field.tag(Sequences([[features(names) for names, *_ in f] for f in found]))
            defects: list[str | None] = []
            at = 0
            for f in found:
                defects.append(pair_defect(f, tags[at : at + len(f)]) if f else "empty")
                at += len(f)
            keep = pa.array([d is not None for d in defects])
            yield pa.RecordBatch.from_arrays([batch.column(key).filter(keep), pa.array([d for d in defects if d], pa.string())], [key, "defect"])

    return tag


def pair_defect(found: list[tuple[list[str], int, bool, bool]], tags: np.ndarray) -> str | None:
    """The defect that the coverage of the clauses' tags tells, if any."""
    if tags[-1] == UNFINISHED:
        return "truncated"
    if any(t == ANSWER and source for t, (*_, source) in zip(tags, found, strict=True)):
        return None
    cover = np.zeros(len(LABELS))
    for t, (_, length, *_) in zip(tags, found, strict=True):
        cover[t] += length
    if cover[REFUSAL]:
        return "refusal"
    return DEFECTS.get(int(cover.argmax()))


def _sample(df: DataFrame, key: str, response: str, rows: int) -> list:
    """The rows of smallest hash. A first cut on the hash keeps what partitions send near three times that number."""
    long_enough = df.where(F.length(response) > 20)
    share = min(1.0, 3 * rows / max(1, df.count()))
    h = F.xxhash64(key)
    few = long_enough.where(h <= int(-(1 << 63) + share * ((1 << 64) - 1))) if share < 1 else long_enough
    got = few.orderBy(h, key).limit(rows).collect()
    return got if len(got) == rows or share == 1 else long_enough.orderBy(h, key).limit(rows).collect()


def broken_pairs(df: DataFrame, key: str, question: str, response: str, schema: str, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(key, defect) of every defective pair."""
    spark = df.sparkSession
    used = df.select(key, question, response, schema)
    sample = _sample(used, key, response, train_rows)
    field, features = train([(r[question], r[response], r[schema]) for r in sample])
    model = spark.sparkContext.broadcast((field.weights, field.moves, list(features.numbers)))
    return used.mapInArrow(_tagger(key, question, response, schema, model), f"{key} {dict(df.dtypes)[key]}, defect string")
