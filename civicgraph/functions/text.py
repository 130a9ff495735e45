"""Keyword and lookup expressions built as single SQL expressions.

Building them as text keeps large rule sets to one call into the JVM; the
result is ordinary codegen'd Catalyst expressions.
"""

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def quote(s: str) -> str:
    """A Spark SQL string literal."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def literal(v) -> str:
    if v is None:
        return "CAST(NULL AS STRING)"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, int):
        return str(v)
    if isinstance(v, float):
        return f"CAST({v!r} AS DOUBLE)"
    return quote(v)


def any_word(expr: str, words) -> str:
    """True when the text contains any of the words; null text is false."""
    tests = " OR ".join(f"contains({expr}, {quote(w)})" for w in words)
    return f"coalesce({tests}, false)"


def any_pattern(expr: str, patterns) -> str:
    """True when any regular expression is found; null text is false."""
    tests = " OR ".join(f"rlike({expr}, {quote(p)})" for p in patterns)
    return f"coalesce({tests}, false)"


def _leading(pattern: str) -> str:
    """The pattern up to its first white space outside parentheses."""
    depth = 0
    for i, ch in enumerate(pattern):
        depth += {"(": 1, ")": -1}.get(ch, 0)
        if depth == 0 and pattern.startswith("\\s", i):
            return pattern[:i]
    return pattern


def pattern_words(pattern: str) -> list:
    """Words of a pattern of which every match holds at least one."""
    pattern = pattern.removeprefix("(?U)")
    bare = lambda p: re.sub(r"[a-z]\?", "", re.sub(r"\\.|\(\?:", " ", p))
    words = lambda p: re.findall(r"[a-z'-]{2,}", bare(p))
    return words(_leading(pattern)) or words(pattern)


def any_worded_pattern(expr: str, patterns) -> str:
    """any_pattern for patterns made of words: a regular expression runs only
    where one of its words occurs, which a plain substring search decides."""
    tests = " OR ".join(f"({any_word(expr, pattern_words(p))} AND rlike({expr}, {quote(p)}))" for p in patterns)
    return f"coalesce({tests}, false)"


def in_set(expr: str, values) -> str:
    """Null-safe membership: null is not a member."""
    return f"coalesce({expr} IN ({', '.join(quote(v) for v in values)}), false)"


def lookup(expr: str, table: dict, default="CAST(NULL AS STRING)") -> str:
    """Value for a key of a small fixed table, else the default expression."""
    pairs = ", ".join(f"{literal(k)}, {literal(v)}" for k, v in table.items())
    return f"coalesce(element_at(map({pairs}), {expr}), {default})"


def first_match(cases, default: str) -> str:
    """CASE over (condition, value) pairs in order."""
    whens = " ".join(f"WHEN {c} THEN {v}" for c, v in cases)
    return f"CASE {whens} ELSE {default} END"


def structs(rows, names) -> str:
    """array<struct> literal of a small fixed table."""
    body = ", ".join("named_struct(" + ", ".join(f"{quote(n)}, {literal(v)}" for n, v in zip(names, r)) + ")"
                     for r in rows)
    return f"array({body})"


def expr(sql: str) -> Column:
    return F.expr(sql)
