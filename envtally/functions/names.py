"""Variable names and the language patterns that find them."""

from __future__ import annotations

import os.path
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The syntax of a variable name and of each way to read one.
# Every pattern has exactly one group, the name.
NAME = r"[A-Z][A-Z0-9_]*"
JS_PATTERNS = (
    r"process\.env\.([A-Z][A-Z0-9_]*)",
    r'process\.env\["([A-Z][A-Z0-9_]*)"\]',
    r"process\.env\['([A-Z][A-Z0-9_]*)'\]",
)
GO_PATTERNS = (
    r'os\.Getenv\("([A-Z][A-Z0-9_]*)"\)',
    r'os\.LookupEnv\("([A-Z][A-Z0-9_]*)"\)',
)
PYTHON_PATTERNS = (
    r'os\.getenv\("([A-Z][A-Z0-9_]*)"\)',
    r'os\.environ\["([A-Z][A-Z0-9_]*)"\]',
    r"os\.environ\['([A-Z][A-Z0-9_]*)'\]",
)

Patterns = Mapping[str, Sequence[str]]

# File extension -> patterns. Pass a copy with more entries to audit more languages.
DEFAULT_PATTERNS: Patterns = {
    ".js": JS_PATTERNS,
    ".ts": JS_PATTERNS,
    ".go": GO_PATTERNS,
    ".py": PYTHON_PATTERNS,
}


def is_valid_name(col: Column) -> Column:
    # \z and not $, which in Java also matches before a final newline.
    return col.rlike(rf"\A{NAME}\z")


def literal_prefix(pattern: str) -> str:
    """Text every match of ``pattern`` must start with; '' if that is not certain.

    Lets a plain substring test reject a text before any regex runs on it.
    """
    if "|" in pattern:
        return ""
    prefix, i = "", 0
    while i < len(pattern):
        char = pattern[i]
        width = 1
        if char == "\\":
            if i + 1 == len(pattern) or pattern[i + 1].isalnum():
                break
            char, width = pattern[i + 1], 2
        elif char in ".^$*+?()[]{}":
            break
        if pattern[i + width : i + width + 1] in ("*", "?", "{"):
            break
        prefix += char
        i += width
    return prefix


def may_match(text: Column, patterns: Sequence[str]) -> Column:
    """False only where no pattern can match."""
    needles = {literal_prefix(p) for p in patterns}
    if not needles or "" in needles:
        return F.lit(True)
    shared = os.path.commonprefix(sorted(needles))
    if len(shared) >= 6:
        # Long enough to be rare: one pass over the text instead of one per needle.
        needles = {shared}
    test = F.lit(False)
    for needle in sorted(needles):
        test = test | text.contains(needle)
    return test


def matches(text: Column, patterns: Sequence[str]) -> Column:
    """Names found by every pattern, one element per occurrence."""
    return F.concat(*[F.regexp_extract_all(text, F.lit(p)) for p in patterns])
