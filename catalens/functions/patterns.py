"""Glob patterns as regular expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _literal(text: str) -> str:
    """Escape regex metacharacters in a form that both Java regex and RE2 accept."""
    return re.sub(r"([\\.+*?^$()\[\]{}|])", r"\\\1", text)


def table_pattern(pattern: str) -> str:
    """``*x`` ends with, ``x*`` starts with, ``a*b`` spans the name, ``x`` and ``*x*`` occur anywhere."""
    head, tail = pattern.startswith("*"), pattern.endswith("*")
    core = pattern[1:] if head else pattern
    core = core[:-1] if tail and core.endswith("*") else core
    body = ".*".join(_literal(p) for p in core.split("*"))
    if head and tail:
        return body
    if head:
        return f"{body}$"
    if tail:
        return f"^{body}"
    return f"^{body}$" if "*" in core else body


def column_pattern(pattern: str, *, anchored: bool = False) -> str:
    """Name patterns of roles. Unanchored by default, so ``*ID`` also occurs in ``Width``.

    Explicit ``^`` or ``$`` makes the pattern a regular expression of its own.
    """
    if "*" not in pattern and (pattern.startswith("^") or pattern.endswith("$")):
        return pattern
    if anchored:
        return table_pattern(pattern)
    return ".*".join(_literal(p) for p in pattern.strip("*").split("*"))


def fnmatch_pattern(pattern: str) -> str:
    """Shell glob for a whole name: ``*`` any text, ``?`` one character, ``[…]`` and ``[!…]`` classes."""
    tokens = re.findall(r"\[!?[^\]]+\]|.", pattern, re.S)
    special = {"*": ".*", "?": "."}
    out = []
    for token in tokens:
        if len(token) > 1:
            out.append("[^" + token[2:] if token.startswith("[!") else token)
        else:
            out.append(special.get(token) or _literal(token))
    return f"^{''.join(out)}$"


def any_match(text: Column, patterns: list[str], *, ignore_case: bool = True) -> Column:
    """True when one of the regexes is found in ``text``; all of them run as one alternation."""
    if not patterns:
        return F.lit(False)
    flag = "(?i)" if ignore_case else ""
    return text.rlike(flag + "|".join(f"(?:{p})" for p in patterns))
