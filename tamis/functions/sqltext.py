"""Text functions over SQL and questions, as native column expressions. Patterns say (?U) where words are Unicode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_QUOTED = "'[^']*(?:''[^']*)*'?|\"[^\"]*(?:\"\"[^\"]*)*\"?|`[^`]*(?:``[^`]*)*`?"

# The keywords a skeleton keeps, and what names a syntax error.
KEYWORDS = "select from where group by having order limit join on and or not in count avg sum min max distinct desc asc union intersect except like between".split()
SYNTAX_MARKS = ["syntax error", "incomplete input", "unrecognized token", "near ", "incomplete statement"]

# What each overlapping query type and each feature looks for.
QUERY_TYPES = {
    "join": r"\bjoin\b", "order_limit": r"\border by\b|\blimit\b", "group_by": r"\bgroup by\b",
    "subquery": r"\(\s*select\b", "set_op": r"\b(union|intersect|except)\b",
}
FEATURES = {
    "join": r"\bjoin\b", "join2": r"\bjoin\b.*\bjoin\b", "join3": r"\bjoin\b.*\bjoin\b.*\bjoin\b", "order_by": r"\border by\b", "limit": r"\blimit\b",
    "group_by": r"\bgroup by\b", "having": r"\bhaving\b", "subquery": r"\(\s*select\b", "set_op": r"\b(union|intersect|except)\b", "distinct": r"\bdistinct\b",
}


def _has(c: Column, pattern: str) -> Column:
    return c.rlike(f"(?isU){pattern}")


def normalize_sql(c: Column) -> Column:
    """Blanks outside quotes become one, none before a comma, none at the ends (FN1)."""
    once = F.regexp_replace(c, f"(?U)({_QUOTED})|\\s*(,)", "$1$2")
    twice = F.regexp_replace(once, f"(?U)((?:{_QUOTED}|[^\\s'\"`])+)\\s*", "$1 ")
    return F.regexp_replace(twice, r"(?U)^\s+|\s+$", "")


def clean_sql(c: Column) -> Column:
    """A model's output without reasoning, fences, prefix and final semicolons, normalised; null stays null (FN2).

    A fence's language may be sqlite or sql: the longer is tried first, a deliberate choice, so that nothing of it is left.
    """
    t = F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    t = F.regexp_replace(t, r"(?isU)^\s*<think>.*?</think>\s*", "")
    t = F.regexp_replace(t, r"(?iU)^```(?:sqlite|sql)?\s*", "")
    t = F.regexp_replace(F.regexp_replace(t, r"(?U)\s*```$", ""), r"(?U)^\s+|\s+$", "")
    t = F.regexp_replace(t, r"(?iU)^SQL(?:Query)?\s*:\s*", "")
    return normalize_sql(F.regexp_replace(t, ";+$", ""))


def token_count(c: Column) -> Column:
    """Lexical tokens (FN3)."""
    # Fixed value: what counts as a token decides the number.
    pattern = "(?U)'(?:''|[^'])*'|\"(?:\"\"|[^\"])*\"|`[^`]*`|\\b\\w+\\b|<=|>=|<>|!=|==|[-+*/(),.;=<>]"
    return F.size(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)))


def number_list(c: Column) -> Column:
    """The numbers of a text as a sorted list: no ordinal endings, no thousands blanks, decimal points; 'more than one' is 1 (FN4)."""
    nb = chr(0xA0)
    pattern = f"(?iU)(?<!\\w)(?:[0-9]{{1,3}}(?:[ {nb}][0-9]{{3}})+|[0-9]+)(?:[.,][0-9]+)?(?:st|nd|rd|th|e|er|ème|s)?(?!\\w)"
    found = F.regexp_extract_all(c, F.lit(pattern), F.lit(0))
    bare = F.transform(found, lambda x: F.translate(F.regexp_replace(x, "(?i)(?:st|nd|rd|th|e|er|ème|s)$", ""), f", {nb}", "."))
    ones = sum((F.regexp_count(c, F.lit(p)) for p in (r"(?iU)\b(?:plus|moins)\s+d[’'](?:une|un)\b", r"(?iU)\b(?:more|less)\s+than\s+one\b", r"(?iU)\b(?:a\s+)?single\b")), F.lit(0))
    return F.array_sort(F.concat(bare, F.array_repeat(F.lit("1"), ones.cast("int"))))


def question_key(c: Column) -> Column:
    """Blanks collapsed, case folded, final punctuation off (FN6)."""
    folded = F.replace(F.lower(F.regexp_replace(c, r"(?U)\s+", " ")), F.lit("ß"), F.lit("ss"))
    return F.regexp_replace(folded, "^[ .?!…]+|[ .?!…]+$", "")


def skeleton(c: Column) -> Column:
    """The structure without names and values (FN7)."""
    # The patterns of values, aliases and words decide which statements share a structure.
    s = F.regexp_replace(F.regexp_replace(F.lower(c), r"[; ]+\z", ""), r"'[^']*'|\"[^\"]*\"|\b[0-9]+(?:\.[0-9]+)?\b", "V")
    s = F.regexp_replace(s, r"\bas t[0-9]\b|\bt[0-9]\.", "")
    words = F.regexp_extract_all(s, F.lit(r"[a-z_][a-z_0-9]*|[^\sa-z_]"), F.lit(0))
    return F.array_join(F.transform(words, lambda w: F.when(~w.rlike("^[a-z_]") | w.isin(*KEYWORDS), w).otherwise("x")), " ")


def structure_class(c: Column) -> Column:
    """set_op, or the joins with nested, having or group, and order (FN8)."""
    s = F.lower(c)
    joins = F.regexp_count(s, F.lit(r"\bjoin\b"))
    return F.when(s.rlike(r"\b(union|intersect|except)\b"), "set_op").otherwise(
        F.concat_ws(
            "+",
            F.when(joins >= 2, "join2+").when(joins == 1, "join1").otherwise("single"),
            F.when(s.rlike(r"\(\s*select\b"), "nested"),
            F.when(s.contains(" having "), "having").when(s.contains(" group by "), "group"),
            F.when(s.rlike(r"\border by\b"), "order"),
        )
    )


def query_types(c: Column) -> dict[str, Column]:
    """Overlapping types (FN9)."""
    flags = {name: _has(c, p) for name, p in QUERY_TYPES.items()}
    return {"one_table": ~flags["join"], **flags, "joins2": F.regexp_count(c, F.lit(r"(?i)\bjoin\b")) >= 2}


def feature_flags(c: Column) -> dict[str, Column]:
    """FN10."""
    return {name: _has(c, p) for name, p in FEATURES.items()}


def is_tautology(c: Column) -> Column:
    """A column that must be IN its own unfiltered table (FN11)."""
    # Fixed value: the one form that counts as a tautology.
    p = r"(?i)from (\w+)\s+where (\w+) in \(\s*select (\w+) from (\w+)\s*\)"
    part = lambda i: F.lower(F.regexp_extract(c, p, i))
    return (part(1) != "") & (part(1) == part(4)) & (part(2) == part(3))


def same_table_unfiltered_subquery(c: Column) -> Column:
    """An IN over an unfiltered sub-query of the outer table (FN12)."""
    outer = F.lower(F.regexp_extract(c, r"(?i)\bfrom\s+(\w+)", 1))
    inner = F.regexp_extract_all(c, F.lit(r"(?i)\bin\s*\(\s*select\s+[\w.]+\s+from\s+(\w+)\s*\)"), F.lit(1))
    return F.exists(inner, lambda t: (F.lower(t) == outer) & (outer != ""))


def unused_join(c: Column) -> Column:
    """A joined table whose alias occurs at most once before a column (FN13)."""
    aliases = F.regexp_extract_all(F.lower(c), F.lit(r"\bjoin\s+\w+\s+as\s+(t[0-9])\b"), F.lit(1))
    return F.exists(aliases, lambda a: F.regexp_count(F.lower(c), F.concat(F.lit(r"\b"), a, F.lit(r"\."))) <= 1)


def superfluous_join(c: Column) -> Column:
    return unused_join(c) & ~_has(c, r"\bgroup by\b")


def has_order_by(c: Column) -> Column:
    """ORDER BY anywhere, sub-queries included (FN14, K5)."""
    return _has(c, r"\border\s+by\b")


def is_syntax_error(c: Column) -> Column:
    """Whether an engine's message tells a parsing error; null tells none (FN15)."""
    low = F.lower(F.coalesce(c, F.lit("")))
    out = F.lit(False)
    for mark in SYNTAX_MARKS:
        out = out | low.contains(mark)
    return out


def guard_scorer(c: Column) -> Column:
    """Read-only as the scorer tells it: SELECT or WITH and a blank (K2)."""
    s = F.upper(F.regexp_replace(c, r"(?U)^\s+", ""))
    return s.startswith("SELECT ") | s.startswith("WITH ") | s.isin("SELECT", "WITH")


def guard_checker(c: Column) -> Column:
    return c.rlike(r"(?iU)^\s*(select|with)\b")


def guard_rescorer(c: Column) -> Column:
    s = F.upper(F.regexp_replace(c, r"(?U)^\s+", ""))
    return s.startswith("SELECT") | s.startswith("WITH")


FORBIDDEN = ["insert", "update", "delete", "drop", "alter", "attach", "detach", "pragma", "vacuum", "replace", "trigger"]


def policy(c: Column, prefix: str, forbidden: list[str] | None = None) -> Column:
    """Every statement starts with the prefix and none holds a forbidden verb (FLT10)."""
    verbs = "|".join(forbidden or [v for v in FORBIDDEN if v != prefix.lower().split()[0]])
    parts = F.filter(F.transform(F.split(c, ";"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")
    ok = F.forall(parts, lambda s: F.upper(s).startswith(prefix.upper()) & ~s.rlike(rf"(?i)\b({verbs})\b"))
    return ok & (F.size(parts) > 0)


def repair_split(c: Column, split: str) -> Column:
    """An id whose prefix was garbled gets the split's; ids without a number stay (FN16)."""
    number = F.regexp_extract(c, r":([0-9]+)$", 1)
    return F.when(number != "", F.concat(F.lit(f"{split}:"), number)).otherwise(c)
