"""Column expressions that depend on options only are built once per process.

Each function call and operator of an expression is a call into the JVM. An expression that
names its columns belongs to no DataFrame, so that scans with equal options can share it.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps
from typing import TypeVar

from pyspark import SparkContext

Built = TypeVar("Built")


def built_once(build: Callable[..., Built]) -> Callable[..., Built]:
    """``build`` with its results kept by arguments, and by the JVM they live in."""
    kept: dict[tuple, Built] = {}

    @wraps(build)
    def columns(*options) -> Built:
        key = (id(SparkContext._gateway), *options)
        if key not in kept:
            kept[key] = build(*options)
        return kept[key]

    return columns


def frozen(patterns) -> tuple:
    """Patterns by extension, or extensions, as a key."""
    if hasattr(patterns, "items"):
        return tuple((ext, tuple(regexes)) for ext, regexes in patterns.items())
    return tuple(patterns)
