"""URL rules as glob patterns, matched by a bit-parallel automaton.

All patterns are packed into one state vector of 64-bit words (Shift-And). Each pattern has
a bit for its start and one for each character; a bit is set while that much of the pattern
matches what has been read. Reading a character shifts the vector by one bit, across words,
and masks it with the bits that the character may set. A bit before a ``*`` also keeps
itself. All rows of a batch advance together, one character at a time.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Verdict, host and start of the path; a rule is for the host and all its subdomains.
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
DEFAULT = "allow"
#: What the query asks of urls that no rule fits: hosts named like link farms, sellers and ad
#: servers. (verdict, pattern over host, tab, path)
GLOBS = (
    ("block", "*spam-????.*\t/*"),
    ("block", "*cheap-*.example.*\t*"),
    ("block", "ads-*\t/??/*"),
)
#: Between host and path. Neither can hold it, so that no ``*`` reaches over it.
SEPARATOR = "#"
_ROWS_AT_ONCE = 4096
_BITS = 64


class Globs:
    """Patterns of ``*`` (any characters, also none), ``?`` (one character) and literals.

    A backslash makes the next character a literal. A pattern matches whole strings.
    """

    def __init__(self, patterns: Sequence[str]) -> None:
        bits = 0
        self.starts, accepts, loops = [], [], []
        literal: dict[str, list[int]] = {}
        anything: list[int] = []
        for pattern in patterns:
            at = bits
            self.starts.append(at)
            characters = iter(pattern)
            for c in characters:
                if c == "*":
                    loops.append(at)
                    continue
                at += 1
                if c == "?":
                    anything.append(at)
                else:
                    literal.setdefault(next(characters, c) if c == "\\" else c, []).append(at)
            accepts.append(at)
            bits = at + 1
        self.words = max(1, -(-bits // _BITS))
        self.accepts = np.array(accepts, np.int64)
        self.start, self.loop = self._packed(self.starts), self._packed(loops)
        other = self._packed(anything)
        self.alphabet = np.array(sorted(map(ord, literal)), np.uint32)
        self.masks = np.stack(
            [other, *(other | self._packed(literal[chr(c)]) for c in self.alphabet.tolist())]
        )

    def _packed(self, bits: Sequence[int]) -> np.ndarray:
        words = np.zeros(self.words, np.uint64)
        for bit in bits:
            words[bit // _BITS] |= np.uint64(1 << bit % _BITS)
        return words

    def matches(self, texts: Sequence[str]) -> np.ndarray:
        """A row per text and a column per pattern: whether it matches."""
        encoded = [t.encode("utf-32-le") for t in texts]
        lengths = np.fromiter(map(len, encoded), np.int64, len(encoded)) // 4
        order = np.argsort(-lengths, kind="stable")
        begin = (np.cumsum(lengths) - lengths)[order]
        characters = np.frombuffer(b"".join(encoded), "<u4") if lengths.any() else np.zeros(0, np.uint32)
        place = np.searchsorted(self.alphabet, characters)
        known = place < len(self.alphabet)
        known[known] = self.alphabet[place[known]] == characters[known]
        symbol = np.where(known, place + 1, 0)
        state = np.tile(self.start, (len(texts), 1))
        falling = -lengths[order]
        for position in range(int(lengths.max(initial=0))):
            rows = int(np.searchsorted(falling, -position))
            now = state[:rows]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(_BITS - 1)
            state[:rows] = moved & self.masks[symbol[begin[:rows] + position]] | now & self.loop
        out = np.empty((len(texts), len(self.accepts)), bool)
        word, bit = self.accepts // _BITS, (self.accepts % _BITS).astype(np.uint64)
        out[order] = state[:, word] >> bit & np.uint64(1)
        return out


def escaped(literal: str) -> str:
    return "".join("\\" + c if c in "*?\\" else c for c in literal)


def rule_globs(rules: Sequence[tuple[str, str, str]]) -> list[tuple[int, str]]:
    """Rule number and pattern: each rule's host itself, and any subdomain of it."""
    out = []
    for number, (_, host, path) in enumerate(rules):
        out.append((number, f"{escaped(host)}{SEPARATOR}{escaped(path)}*"))
        out.append((number, f"*.{escaped(host)}{SEPARATOR}{escaped(path)}*"))
    return out


def canonical(pages: DataFrame) -> DataFrame:
    """``page_id, host, path`` of each url.

    The host follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower
    case; the path goes on up to ``?``, ``#`` or the end. Both are empty for a url that is
    null or has no ``://``.
    """
    rest = F.when(
        F.instr("url", "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")
    ).otherwise("")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.regexp_extract(rest, r"(?s)^([^/?#]*)([^?#]*)", 1).alias("host"),
        F.regexp_extract(rest, r"(?s)^([^/?#]*)([^?#]*)", 2).alias("path"),
    )
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return rows.withColumn("host", F.translate("host", upper, upper.lower()))


def judge(
    pages: DataFrame,
    rules: Sequence[tuple[str, str, str]] = RULES,
    globs: Sequence[tuple[str, str]] = (),
    default: str = DEFAULT,
) -> DataFrame:
    """``page_id, host, path, rule, verdict`` for each row of ``pages (page_id, url)``.

    Of the rules that fit, the longest (host and path) wins, of equally long ones the first
    in code point order. Where none fits, ``rule`` is null and the first of ``globs``
    (verdict, pattern over host, tab, path) that matches decides, else ``default``. Further
    tabs of a pattern, and those of a url, are characters like others. A null or empty url has
    an empty host, which no rule fits. Urls of any length are matched whole. Repeated rows
    repeat, a null page_id stays null, no rows give no rows, other columns are not read.
    """
    named = sorted(
        ((verdict, host, path, host + path) for verdict, host, path in rules),
        key=lambda r: (-len(r[3]), r[3]),
    )
    patterns = rule_globs([r[:3] for r in named])
    owner = [number for number, _ in patterns] + [len(named) + i for i in range(len(globs))]
    names = [r[3] for r in named] + [None] * (len(globs) + 1)
    verdicts = [r[0] for r in named] + [v for v, _ in globs] + [default]
    all_patterns = [p for _, p in patterns] + [p.replace("\t", SEPARATOR, 1) for _, p in globs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Globs(all_patterns)
        # Patterns are in the order in which they win; the last column always matches.
        winner = np.array([*owner, len(names) - 1])
        for batch in batches:
            for at in range(0, len(batch), _ROWS_AT_ONCE):
                part = batch.slice(at, _ROWS_AT_ONCE)
                hosts, paths = part.column(1).to_pylist(), part.column(2).to_pylist()
                matched = automaton.matches([f"{h}{SEPARATOR}{p}" for h, p in zip(hosts, paths)])
                always = np.ones((len(part), 1), bool)
                first = winner[np.hstack([matched, always]).argmax(axis=1)].tolist()
                yield pa.RecordBatch.from_arrays(
                    [
                        *part.columns,
                        pa.array([names[i] for i in first], pa.string()),
                        pa.array([verdicts[i] for i in first], pa.string()),
                    ],
                    ["page_id", "host", "path", "rule", "verdict"],
                )

    return canonical(pages).mapInArrow(
        run, "page_id long, host string, path string, rule string, verdict string"
    )
