"""Clauses of a response and their features for the conditional random field.

Features are general: classes of tokens (SQL's own words, names of the schema, literals, other words), n-grams of the classes
and of the other words' letters, the pattern of a statement's last condition, and how much of the question recurs. No list
says what a refusal, another language or an unfinished statement looks like; the field learns that.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

from tamis.functions.words import plain
from tamis.llm.statements import SQL_WORDS, TOKENS

LABELS = ("answer", "refusal", "echo", "foreign", "unfinished", "void")

HEADS = frozenset("select from where group having order limit except union intersect".split())
SENTENCES = re.compile(r"(?<=[.!?;:])\s+")
WRAPPER = re.compile(r"(?is)^\s*(?:```[\w+-]*[^\S\n]*\n?|<(\w+)>|(?:sql(?:query)?|requ[eê]te|query|r[eé]ponse|answer)\s*:)")
CLOSER = re.compile(r"(?is)(?:\n?\s*```|</\w+>)\s*$")
COMMENT = re.compile(r"(?s)'(?:[^']|'')*'|/\*(.*?)(?:\*/|$)|--([^\n]*)")  # or a literal, where no comment begins
_STATEMENT = re.compile(r"(?i)\(?\s*(?:select|with)\b")
_LITERAL = re.compile(r"(?is)\(?\s*select\s+'(.*)'?\s*;?\s*$")
_SEGMENT = frozenset("select from join on where and or having by limit offset except union intersect".split())
_VALUE = re.compile(r"[^\W_]*\d[\w-]*")


def unwrap(text: str | None) -> str:
    """The response without fences, tags, prefixes, quotes and a JSON shell around it."""
    t = (text or "").replace("​", "").replace("﻿", "").strip()
    for _ in range(4):
        before = t
        t = CLOSER.sub("", WRAPPER.sub("", t)).strip()
        if t[:1] == "{" and t[-1:] == "}":
            try:
                inner = json.loads(t)
            except ValueError:
                inner = None
            if isinstance(inner, dict):
                t = " ".join(v for v in inner.values() if isinstance(v, str)).strip()
        if len(t) > 1 and t[0] == t[-1] and t[0] in "\"'`" and t[0] not in t[1:-1]:
            t = t[1:-1].strip()
        if t == before:
            break
    return t


def _bucket(x: float, steps: tuple[float, ...]) -> int:
    return sum(x >= s for s in steps)


class Features:
    """Names of features to numbers, fixed once the field is trained."""

    def __init__(self, names: list[str] | None = None):
        self.numbers: dict[str, int] = {n: i for i, n in enumerate(names or [])}
        self.closed = names is not None

    def __call__(self, names: list[str]) -> list[int]:
        if self.closed:
            return [self.numbers[n] for n in names if n in self.numbers]
        return [self.numbers.setdefault(n, len(self.numbers)) for n in names]


@lru_cache(maxsize=4096)
def _names(schema: str) -> frozenset[str]:
    return frozenset(re.findall(r"\w+", schema.lower()))


@lru_cache(maxsize=4096)
def _grams(word: str) -> tuple[str, ...]:
    """A word and its runs of four letters."""
    w = f"_{word}_"
    return (f"w={word}", *(f"4={w[i : i + 4]}" for i in range(max(1, len(w) - 3))))


def _classes(tokens: list[str], known: frozenset[str]) -> list[str]:
    """The class of each token: SQL words, marks and operators as they are; I names of the schema or seen before, A aliases,
    S and Q quoted, N numbers, W other words; s and q are quotes left open, I. a name without its second part."""
    low = [t.lower() for t in tokens]
    aliases = {low[i + 1] for i in range(len(low) - 1) if low[i] == "as"}
    out = []
    before: set[str] = set()
    for t in low:
        first = t[0]
        if first in "'\"`":
            closed = len(t) > 1 and t[-1] == first and (first != "'" or t.count("'") % 2 == 0)
            out.append(("S" if closed else "s") if first == "'" else "Q" if closed else "q")
        elif first.isdigit():
            out.append("N")
        elif first.isalpha() or first == "_":
            name = t.rpartition(".")[2]
            out.append(t if t in SQL_WORDS else "I." if not name else "I" if name in known or not known or name in before else "A" if t in aliases else "W")
            before.add(name)
        else:
            out.append(t)
    return out


def _last_class(token: str, kind: str, known: frozenset[str], asked: set[str]) -> str:
    """A last token may be the beginning of a name, of a word of SQL or of a number asked for.

    N= is a number asked for, or any where the question holds none; N< is the beginning of one.
    """
    low = token.lower()
    if kind == "N":
        return "N=" if low in asked or not asked else "N<" if any(a.startswith(low) for a in asked) else "N"
    if kind == "W" and ((name := low.rpartition(".")[2]) and (any(k.startswith(name) for k in known) or any(k.startswith(name) for k in SQL_WORDS))):
        return "P"
    return kind


def _end(tokens: list[str], kinds: list[str], asked: int, missing: int) -> list[str]:
    """Features of a statement's end: its last condition or list, as far as the parenthesis it stands in."""
    depth = 0
    segment: list[str] = []
    at = len(kinds) - 1
    while at >= 0:
        t = kinds[at]
        if t == ")":
            depth += 1
            if depth == 1:
                segment.append("()")
        elif t == "(":
            if depth == 0:  # the innermost that is open
                segment.append("(")
                break
            depth -= 1
        elif depth == 0:
            segment.append(t)
            if t in _SEGMENT and not (t == "and" and "between" in kinds[max(0, at - 3) : at]):
                break
        at -= 1
    segment.reverse()
    head = segment[0] if segment else ""
    rest = segment[1:]
    while len(rest) > 4 and rest[1] == ",":  # a list is as long as its last parts
        rest = rest[2:]
    last = kinds[-1]
    lack = f"lack={_bucket(missing, (1, 2)) if missing < asked else 'all' if asked else 'none'}"
    names = [f"last={last}", f"last2={' '.join(kinds[-2:])}", f"last3={' '.join(kinds[-3:])}", f"part={head}|{' '.join(rest[-6:])}", f"head={head}|{last}", f"{lack}|{head}|{last}"]
    open_ = kinds.count("(") - kinds.count(")")
    names.append(f"open={_bucket(open_, (1, 2))}")
    if tokens[-1][0] not in "'\"`" and not tokens[-1][0].isalnum() and tokens[-1] not in (")", "*"):
        names.append("mark")
    return names


def without_comments(response: str) -> tuple[str, list[str]]:
    """The text outside comments, and the comments."""
    if "--" not in response and "/*" not in response:
        return response, []
    comments: list[str] = []

    def note(m: re.Match) -> str:
        if m[1] is None and m[2] is None:
            return m[0]
        comments.append(m[1] if m[1] is not None else m[2])
        return " "

    return COMMENT.sub(note, response), comments


def _statement(code: str, question: str | None, known: frozenset[str], first: bool) -> list[tuple[list[str], int, bool, bool]]:
    """The clauses of a statement, cut before its head words."""
    code = code.rstrip().rstrip(";").rstrip()
    spans = [(m.start(), m[0]) for m in TOKENS.finditer(code)]
    tokens = [t for _, t in spans]
    kinds = _classes(tokens, known)
    heads = [i for i, k in enumerate(kinds) if k in HEADS] or [0]
    heads[0] = 0
    out = []
    for at, until in zip(heads, [*heads[1:], len(kinds)], strict=True):
        part = kinds[at:until]
        head = next((k for k in part if k in HEADS), "")
        length = (spans[until][0] if until < len(spans) else len(code)) - spans[at][0]
        names = ["bias", "code", *(["first"] if first and at == 0 else []), f"clause={head}", f"others={_bucket(part.count('W'), (1, 2, 4, 7))}", f"beside={any(a == b == 'W' for a, b in zip(part, part[1:], strict=False))}"]
        out.append((names, length, True, head == "from"))
    asked = set(_VALUE.findall((question or "").lower()))
    if kinds[-2:-1] != ["limit"]:
        kinds[-1] = _last_class(tokens[-1], kinds[-1], known, asked)
    lower = code.lower()
    out[-1][0].extend(["last", *_end(tokens, kinds, len(asked), sum(v not in lower for v in asked))])
    return out


def _free(text: str, kind: str, asked_pairs: set[tuple[str, str]], known: frozenset[str]) -> list[str]:
    """Features of a clause that is no statement's."""
    tokens = TOKENS.findall(text.replace("'", " ").replace('"', " "))
    kinds = _classes(tokens, known)
    spoken = [plain(t) if k == "W" else k for t, k in zip(tokens, kinds, strict=True)]
    others = {t for t, k in zip(spoken, kinds, strict=True) if k == "W"}
    sql = sum(k in SQL_WORDS for k in kinds)
    marks = sum(not (k[0].isalnum() or k in ",.;:!?()…") for k in kinds)
    short = [k for i, k in enumerate(kinds) if i == 0 or kinds[i - 1] != k]
    names = [kind, f"names={_bucket(kinds.count('I'), (1, 2, 3, 5))}", f"numbers={_bucket(kinds.count('N'), (1, 2, 4))}", f"sql={_bucket(sql, (1, 2, 4))}", f"marks={_bucket(marks, (1, 2, 4, 8))}", f"long={_bucket(len(kinds), (2, 4, 8, 20, 60))}"]
    names += sorted({f"kinds={a} {b}" for a, b in zip(short, short[1:], strict=False)})
    names += sorted({g for w in others for g in _grams(w)}) + sorted({f"2={a} {b}" for a, b in zip(spoken, spoken[1:], strict=False)})
    w = re.findall("[a-z0-9]+", plain(text))
    pairs = list(zip(w, w[1:], strict=False))
    share = sum(p in asked_pairs for p in pairs) / max(1, len(pairs))
    return [*names, f"asked={_bucket(share, (0.01, 0.2, 0.4, 0.6, 0.8)) if len(pairs) > 2 else 'short'}"]


def clauses(response: str, question: str | None, schema: str | None) -> list[tuple[list[str], int, bool, bool]]:
    """The clauses of an unwrapped response, comments first: features, length, and whether it is a statement's, and a FROM clause."""
    code, comments = without_comments(response)
    known = _names(schema or "")
    free = [(c, "comment") for text in comments for c in SENTENCES.split(text) if re.search(r"\w", c)]
    literal = _LITERAL.match(code)
    statement = not literal and _STATEMENT.match(code.lstrip())
    if not statement:
        free += [(c, "literal" if literal else "free") for c in SENTENCES.split(literal[1] if literal else code) if re.search(r"\w", c)]
    out = []
    if free:
        q = re.findall("[a-z0-9]+", plain(question))
        asked_pairs = set(zip(q, q[1:], strict=False))
        for i, (text, kind) in enumerate(free):
            names = ["bias", "comment" if kind == "comment" else "code", *(["first"] if i == 0 else []), *(["last"] if i == len(free) - 1 and not statement else [])]
            out.append((names + _free(text, kind, asked_pairs, known), len(text.strip()), False, False))
    return out + (_statement(code.strip(), question, known, not free) if statement else [])
