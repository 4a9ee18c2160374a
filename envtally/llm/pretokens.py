"""Cutting text into the pre-tokens of a byte-level tokenizer, and reading its vocabulary."""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator
from itertools import islice

import regex

#: Texts above this many characters are cut by an iterator, so that no list holds them whole.
_LONG = 1 << 20
_AT_ONCE = 1 << 17
_CLASSES = {r"\p{L}": r"\p{L}", r"\p{N}": r"\p{N}", r"\s": r"\p{White_Space}"}


def read_ranks(path: str) -> dict[bytes, int]:
    """Pieces and ranks of a vocabulary file: base64 and rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, lines))}


def splitter(pattern: str) -> Callable[[str], Iterator[list[str]]]:
    """A function from a text to its pre-tokens, in lists of bounded length.

    White space is the Unicode property. Text whose characters are all below U+0100 is cut
    by an equal pattern with the classes spelled out, which the standard engine runs faster.
    """
    general = regex.compile(
        pattern.replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}")
    )
    narrow = re.compile(_spelled_out(pattern))

    def split(text: str) -> Iterator[list[str]]:
        try:
            text.encode("latin-1")
            compiled = narrow
        except UnicodeEncodeError:
            compiled = general
        if len(text) <= _LONG:
            yield compiled.findall(text)
            return
        found = (m.group() for m in compiled.finditer(text))
        while part := list(islice(found, _AT_ONCE)):
            yield part

    return split


def _spelled_out(pattern: str) -> str:
    """``pattern`` with its classes replaced by their characters below U+0100."""
    members = {
        name: "".join(
            f"\\x{i:02x}" for i in range(256) if regex.fullmatch(unicode_class, chr(i))
        )
        for name, unicode_class in _CLASSES.items()
    }
    inside = r"\[\^((?:\\p\{[LN]\}|\\s)+)\]"
    out = re.sub(
        inside,
        lambda m: "[^" + "".join(members[c] for c in re.findall(r"\\p\{[LN]\}|\\s", m[1])) + "]",
        pattern,
    )
    out = out.replace(r"\S", f"[^{members[r'\s']}]")
    for name, characters in members.items():
        out = out.replace(name, f"[{characters}]")
    return out
