"""Texts as arrays of word numbers."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np

_PART = 1 << 22
_BLANK = re.compile(rb"[\x20\x09-\x0D]")


def vocabulary() -> defaultdict[bytes, int]:
    """A dict that numbers words as they come."""
    numbers: defaultdict[bytes, int] = defaultdict(count().__next__)
    return numbers


def _parts(data: bytes) -> Iterator[bytes]:
    """``data`` cut at blanks, so that no list holds all words of a very long text."""
    at = 0
    while len(data) - at > _PART:
        blank = _BLANK.search(data, at + _PART)
        end = blank.start() if blank else len(data)
        yield data[at:end]
        at = end
    yield data[at:] if at else data


def numbered(data: bytes, numbers: defaultdict[bytes, int]) -> np.ndarray:
    """The numbers of the words of ``data``; words end at space and 0x09-0x0D."""
    found = []
    for part in _parts(data):
        words = part.split()
        found.append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))
    return found[0] if len(found) == 1 else np.concatenate(found)
