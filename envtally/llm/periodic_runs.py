"""Runs of repeated words by the branching-tandem test on an enhanced suffix array.

The texts of a batch are one sequence of word numbers, each text closed by a number of its
own, so that no repeat reaches over a border. Its suffix array comes from prefix doubling;
the rank tables of the rounds stay and give the longest common extension of any two
positions exactly. An LCP interval of depth d holds the suffixes that share d words. A
square of period d that ends a run starts at a suffix i of the interval whose suffix i + d
lies in another child of it. For all children but the largest, each suffix i is tested
against i + d and i - d by its place in the suffix array; so every such square is met, with
n log n tests at most, and no tree is built. A square is then rotated to the left as far as
the period holds, which gives the run; of equal stretches the smallest period counts.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from envtally.llm.words import numbered, vocabulary

MIN_LENGTH = 6
MIN_EXPONENT = 4
#: Words that are searched together; a longer text is searched alone.
BATCH_WORDS = 1 << 18
_TESTS_AT_ONCE = 1 << 20
_JUMPS = 16
RUN = "struct<start: bigint, length: bigint, period: bigint>"


def suffix_array(symbols: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The suffix array, and rank tables: table k ranks the first 2**k symbols of a suffix.

    A rank is the place of the first suffix that shares those symbols. The last table ranks
    whole suffixes. No two suffixes may run into the end together: the last symbol is unique.
    """
    n = len(symbols)
    suffixes = np.argsort(symbols, kind="stable").astype(np.int32)
    keys = symbols[suffixes]
    places = np.arange(n, dtype=np.int32)
    tables: list[np.ndarray] = []
    ranks = np.empty(n, np.int32)
    step = 0
    while True:
        new = np.ones(len(keys), bool)
        np.not_equal(keys[1:], keys[:-1], out=new[1:])
        first = np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0))
        ranks[suffixes[places]] = places[first]
        tables.append(ranks.copy())
        shared = ~new
        shared[:-1] |= ~new[1:]
        places = places[shared]
        if not len(places):
            return suffixes, tables
        step = 2 * step or 1
        # Suffixes that still share a rank are ordered by what follows.
        left = suffixes[places]
        keys = ranks[left].astype(np.int64) << 32 | ranks[left + step]
        order = np.argsort(keys)
        suffixes[places] = left[order]
        keys = keys[order]


def common_after(tables: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many symbols from ``x`` on equal those from ``y`` on, for pairs of positions."""
    alike: list[np.ndarray] = []
    at = np.arange(len(x))
    for table in tables:
        at = at[table[x[at]] == table[y[at]]]
        if not len(at):
            break
        alike.append(at)
    length = np.zeros(len(x), np.int32)
    for k in range(len(alike) - 1, -1, -1):
        at = alike[k]
        a, b = x[at] + length[at], y[at] + length[at]
        length[at] += (tables[k][a] == tables[k][b]).astype(np.int32) << k
    return length


def common_before(tables: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many symbols before ``x`` equal those before ``y``; ``x`` is below ``y``."""
    length = np.zeros(len(x), np.int64)
    for k in range(len(tables) - 1, -1, -1):
        a = x - length - (1 << k)
        ok = a >= 0
        a = np.where(ok, a, 0)
        ok &= tables[k][a] == tables[k][np.where(ok, y - length - (1 << k), 0)]
        length += ok.astype(np.int64) << k
    return length


def nearest_smaller(values: np.ndarray) -> np.ndarray:
    """For each place the nearest one to the left with a smaller value.

    The first value must be smaller than all others; its own result means nothing. Pointers
    jump over what is known not to be smaller; the few that climb long stairs go on by
    minima of blocks.
    """
    n = len(values)
    left = np.arange(-1, n - 1)
    left[0] = 0
    at = np.flatnonzero(values[left] >= values)
    at = at[at > 0]
    for _ in range(_JUMPS):
        if not len(at):
            return left
        left[at] = left[left[at]]
        at = at[values[left[at]] >= values[at]]
    if len(at):
        minima = [values]  # minima[k][i]: of the 2**k values up to place i
        while 2 << len(minima) - 1 <= n:
            half = 1 << len(minima) - 1
            below = minima[-1].copy()
            np.minimum(minima[-1][half:], minima[-1][:-half], out=below[half:])
            minima.append(below)
        for k in range(len(minima) - 1, -1, -1):
            here = left[at]
            skip = (here + 1 >= 1 << k) & (minima[k][here] >= values[at])
            left[at] = here - (skip.astype(left.dtype) << k)
    return left


def _children(lcp: np.ndarray, min_size: int) -> tuple[np.ndarray, ...]:
    """Children, but the largest, of the LCP intervals of ``min_size`` suffixes or more.

    Returns for each child its first place and the one after its last, those of its
    interval, and the depth of the interval.
    """
    n = len(lcp)
    low = np.concatenate([[-1], lcp[1:], [-1]]).astype(np.int32)
    begin = nearest_smaller(low)
    end = n - nearest_smaller(low[::-1])[::-1]
    cut = np.flatnonzero(low > 0)
    cut = cut[end[cut] - begin[cut] >= min_size]
    if not len(cut):
        return (np.zeros(0, np.int64),) * 5
    # Cuts of one interval share its ends.
    cut = cut[np.argsort(begin[cut] * (n + 1) + end[cut], kind="stable")]
    first = np.ones(len(cut), bool)
    first[1:] = (begin[cut][1:] != begin[cut][:-1]) | (end[cut][1:] != end[cut][:-1])
    interval = np.cumsum(first) - 1
    heads = np.flatnonzero(first)
    count = len(cut) + len(heads)
    starts, ends = np.empty(count, np.int64), np.empty(count, np.int64)
    own = np.arange(len(cut)) + interval + 1
    outer = heads + np.arange(len(heads))
    starts[own], starts[outer] = cut, begin[cut[heads]]
    last = np.append(heads[1:], len(cut)) - 1
    ends[own[:-1]] = cut[1:]
    ends[own[last]] = end[cut[last]]
    ends[outer] = cut[heads]
    members = np.diff(np.append(outer, count))
    size = ends - starts
    is_most = size == np.repeat(np.maximum.reduceat(size, outer), members)
    seen = np.cumsum(is_most)
    most = is_most & (seen - np.repeat(seen[outer] - is_most[outer], members) == 1)
    head = np.repeat(cut[heads], members)
    return tuple(a[~most] for a in (starts, ends, begin[head], end[head], low[head].astype(np.int64)))


def find_runs(
    symbols: np.ndarray, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT
) -> np.ndarray:
    """Rows ``start, length, period`` of the runs of ``symbols``, in this order.

    A run is a stretch with smallest period q and max(min_length, min_exponent * q) symbols
    or more that no neighbour extends. ``min_exponent`` is 2 or more; the last symbol must
    be unique.
    """
    suffixes, tables = suffix_array(symbols)
    place = tables[-1]
    lcp = np.zeros(len(symbols), np.int32)
    lcp[1:] = common_after(tables, suffixes[:-1], suffixes[1:])
    # The period of a run occurs at as many places as it fits in less one, and once more.
    starts, ends, begins, closes, depths = _children(lcp, min_exponent)
    squares = []
    sizes = ends - starts
    upto = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        before = upto[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(upto, before + _TESTS_AT_ONCE, "right")))
        part, many = slice(at, stop), sizes[at:stop]
        offset = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        low, high = np.repeat(starts[part], many), np.repeat(ends[part], many)
        begin, close = np.repeat(begins[part], many), np.repeat(closes[part], many)
        depth = np.repeat(depths[part], many)
        suffix = suffixes[low + offset].astype(np.int64)
        for start, other in ((suffix, suffix + depth), (suffix - depth, suffix - depth)):
            where = place[np.maximum(other, 0)]
            hit = (other >= 0) & (where >= begin) & (where < close) & ((where < low) | (where >= high))
            squares.append(np.stack([start[hit], depth[hit]], axis=1))
        at = stop
    if not squares:
        return np.zeros((0, 3), np.int64)
    start, period = np.unique(np.concatenate(squares), axis=0).T
    rotated = common_before(tables, start, start + period)
    runs = np.stack([start - rotated, 2 * period + rotated, period], axis=1)
    runs = runs[runs[:, 1] >= np.maximum(min_length, min_exponent * period)]
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    new = np.ones(len(runs), bool)
    new[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
    return runs[new]


def _of_batch(texts: Sequence[bytes]) -> Iterator[tuple[np.ndarray, bytes]]:
    """For each text its runs and the text that is left when repeats are dropped."""
    numbers = vocabulary()
    coded = [numbered(text, numbers) for text in texts]
    sizes = np.array([len(c) + 1 for c in coded])
    ends = np.cumsum(sizes)
    symbols = np.empty(ends[-1], np.int64)
    span = len(numbers)
    for k, (code, end) in enumerate(zip(coded, ends)):
        # Words of different texts differ, so texts never share an interval.
        symbols[end - len(code) - 1 : end - 1] = code
        symbols[end - len(code) - 1 : end - 1] += k * (span + 1)
        symbols[end - 1] = k * (span + 1) + span
    runs = find_runs(symbols)
    change = np.zeros(len(symbols) + 1, np.int32)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    kept = np.cumsum(change)[:-1] == 0
    words = list(numbers)
    bounds = np.searchsorted(runs[:, 0], np.append(0, ends))
    for k, (code, end) in enumerate(zip(coded, ends)):
        begin = end - len(code) - 1
        own = runs[bounds[k] : bounds[k + 1]] - (begin, 0, 0)
        left = code[kept[begin : end - 1]] if len(own) else code
        yield own, b" ".join([words[c] for c in left.tolist()])


def _batches(texts: Sequence[bytes]) -> Iterator[Sequence[bytes]]:
    """``texts`` in lists of about BATCH_WORDS words; each text is whole."""
    at, size = 0, 0
    for k, text in enumerate(texts):
        # A word and a blank are two bytes at least; prose has some six.
        size += len(text) // 6 + 1
        if size >= BATCH_WORDS:
            yield texts[at : k + 1]
            at, size = k + 1, 0
    if at < len(texts):
        yield texts[at:]


def periodic_runs(docs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys`` of ``docs (text, ...)``, with ``runs`` and ``collapsed``.

    runs is an array of structs of start (a word number from 0), length and period, in this
    order; collapsed is the text whose words are joined by one space, without those that a
    run holds after its first period.

    Words are what stands between space and 0x09-0x0D. A null or empty text has no runs and
    an empty collapsed text. A text is searched whole, at any length, and alone if it is
    long. Rows are independent: repeated ones give the same, no rows give no rows. ``keys``
    may have any name but runs and collapsed; other columns are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() or b"" for t in batch.column(batch.num_columns - 1).cast(pa.binary())]
            at = 0
            for part in _batches(texts):
                found = list(_of_batch(part))
                spans = np.concatenate([r for r, _ in found])
                runs = pa.ListArray.from_arrays(
                    pa.array(np.cumsum([0, *(len(r) for r, _ in found)]), pa.int32()),
                    pa.StructArray.from_arrays([pa.array(c) for c in spans.T], ["start", "length", "period"]),
                )
                collapsed = pa.array([c for _, c in found], pa.binary()).cast(pa.string())
                own = batch.slice(at, len(part)).columns[:-1]
                yield pa.RecordBatch.from_arrays([*own, runs, collapsed], [*keys, "runs", "collapsed"])
                at += len(part)

    rows = docs.select(*keys, F.col("text").cast("string").alias("_text"))
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{types}, runs array<{RUN}>, collapsed string")
