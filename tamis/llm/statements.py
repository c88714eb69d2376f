"""Tokens of SQL statements and how a statement stands at its end, for texts that close with one."""

from __future__ import annotations

import re

SQL_WORDS = frozenset(
    "select from where join inner left right full outer cross on as and or not in like between is null exists group by having order asc desc limit offset distinct count sum avg min max union all intersect except with case when then else end cast".split()
)
TOKENS = re.compile(r"'(?:[^']|'')*'?|\"[^\"]*\"?|`[^`]*`?|\w+(?:\.\w*)?|[<>!=]+|…|\.{3}|\S")
DANGLING = frozenset("select from where join on as and or not in like between is group order by having limit offset distinct union all intersect except with inner left right outer when then else case".split())
OPERATORS = frozenset(["=", "<", ">", "<=", ">=", "<>", "!=", "==", "like", "in", "is", "between", "exists"])


def open_state(statement: str, known: frozenset[str], asked: frozenset[str]) -> str:
    """How a statement stands at its end: 'whole', or what it still lacks.

    known: identifiers of the schema; asked: the numbers of the question.
    """
    s = statement.rstrip().rstrip(";").rstrip()
    if not s:
        return "whole"
    if s.endswith(("...", "…", "[...]", "[…]")):
        return "ellipsis"
    tokens = TOKENS.findall(s)
    low = [t.lower() for t in tokens]
    last = low[-1]
    if last[0] in "'\"`" and (len(last) == 1 or last[-1] != last[0] or (last[0] == "'" and last.count("'") % 2)):
        return "quote"
    if last in DANGLING or last in OPERATORS or last in ",(" or last[-1] == "." or last in "+-/":
        return "dangling"
    if low.count("(") > low.count(")"):
        return "paren"
    named = last[0].isalpha() or last[0] == "_"
    if named and last not in ("asc", "desc", "null", "end"):
        name = last.rpartition(".")[2]
        if known and name not in known and low[:-1].count(last) + sum(t.endswith("." + name) or t == name for t in low[:-1]) == 0 and not re.fullmatch(r"t\d+", name):
            return "unknown"
        if "." not in last and re.fullmatch(r"t\d+", name) and len(low) > 1 and low[-2] != "as":
            return "dangling"
    depth, at = 0, len(low) - 1
    while at >= 0:  # the last keyword outside the parentheses closed before the end
        t = low[at]
        depth += (t == ")") - (t == "(")
        if depth == 0 and t in ("where", "and", "or", "on", "having", "from", "join", "select", "by", "limit", "except", "union", "intersect"):
            break
        at -= 1
    if at >= 0:
        rest, t, inside = [], low[at], 0
        for x in low[at + 1 :]:
            inside -= x == ")"
            if not inside:
                rest.append(x)
            inside += x == "("
        if t == "limit":
            return "whole"
        if t == "and" and at >= 2 and "between" in low[max(0, at - 3) : at]:
            return _cut_number(last, asked)
        if t in ("where", "and", "or", "on", "having"):
            if not any(x in OPERATORS for x in rest):
                return "nopredicate"
            if "between" in rest:
                return "dangling"
        if t == "select" and not any(x[0] in "'\"" or x[0].isdigit() or x == "null" for x in rest):
            return "nofrom"
        if t == "join":
            return "nojoin"
        if t == "from":
            return "fromend"
    return _cut_number(last, asked)


def _cut_number(last: str, asked: frozenset[str]) -> str:
    if last.isdigit() and last not in asked and len(last) > 1 and any(n.startswith(last) for n in asked):
        return "number"
    return "whole"
