"""Phrase mining over vertically partitioned, depth-truncated suffix trees (after ERA).

Every word of a piece starts a suffix, cut off after DEPTH words. A task sorts the suffixes
of RUN_WORDS words at a time into a run of distinct ones with counts: the leaves that these
words give to the trees. The word prefixes are then partitioned vertically: a prefix with
more leaves than its share of the memory budget is extended by the next word, again and
again, until each is small, and small prefixes are grouped until a group fills the budget.
The leaves of a group are sent to one task, which builds its subtree, as a sorted array,
without looking at any other group. The count of a node is the total of the leaves below it.
Prefixes that were extended are nodes above several subtrees; their counts are already known
from the partitioning.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from envtally.llm.storage import written
from envtally.llm.words import numbered, vocabulary

DEPTH = 4
MIN_COUNT = 30
COVER_PERCENT = 80
TOP = 2000
#: Words whose suffixes become one run.
RUN_WORDS = 1 << 20
#: The memory budget of a group, in leaves of its runs (some 100 bytes each while it is built).
GROUP_LEAVES = 1 << 21
#: A prefix of more than this part of the budget is extended. At most MOST_EXTENDED of a
#: length are, because all others together have fewer leaves; so they can be broadcast.
PREFIX_PART = 8
MOST_EXTENDED = 1 << 20
_SALTS = 64
# What ends a piece, and a byte that no UTF-8 text has.
_ENDS = bytes.maketrans(b".,;:!?\x0a\x0b\x0c\x0d", b"\n" * 10)
_BREAK = b"\xff"
_RUN = "lang string, leaves long, vocabulary_bytes long, vocabulary binary, suffixes binary"

Run = tuple[list[bytes], np.ndarray, np.ndarray]


def _packed(words: list[bytes], suffixes: np.ndarray, counts: np.ndarray) -> tuple[int, int, bytes, bytes]:
    """A run as the four last columns of _RUN; suffixes has a column per word, 0 for none."""
    text = b" ".join(words)
    numbers = np.concatenate([*suffixes.T, counts]).astype("<u4")
    # Equal bytes of the numbers side by side compress better.
    planes = numbers.view(np.uint8).reshape(-1, 4).T.tobytes()
    squeeze = partial(pa.compress, codec="zstd", asbytes=True)
    return len(counts), len(text), squeeze(text), squeeze(planes)


def _unpacked(leaves: int, size: int, text: bytes, planes: bytes) -> Run:
    """Words (number 1 is the first), suffixes and counts of a packed run."""
    words = pa.decompress(text, size, "zstd", asbytes=True).split(b" ")
    flat = pa.decompress(planes, leaves * (DEPTH + 1) * 4, "zstd", asbytes=True)
    numbers = np.frombuffer(flat, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel()
    columns = numbers.astype(np.int64).reshape(DEPTH + 1, leaves)
    return words, columns[:-1].T, columns[-1]


def _unpacked_rows(batches: Iterator[pa.RecordBatch], first: int = 0) -> Iterator[tuple[str, Run]]:
    for batch in batches:
        for lang, *packed in zip(*(batch.column(first + k).to_pylist() for k in range(5))):
            yield lang, _unpacked(*packed)


def _distinct(suffixes: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows of ``suffixes`` in order, and their total counts."""
    pairs = suffixes[:, 0::2] << 32 | suffixes[:, 1::2]
    order = np.lexsort(tuple(pairs[:, k] for k in range(pairs.shape[1] - 1, -1, -1)))
    pairs = pairs[order]
    new = np.ones(len(pairs), bool)
    new[1:] = (pairs[1:] != pairs[:-1]).any(axis=1)
    at = np.flatnonzero(new)
    if counts is None:
        totals = np.diff(np.append(at, len(pairs)))
    else:
        totals = np.add.reduceat(counts[order], at)
    return suffixes[order[at]], totals


class _Sorter:
    """Collects the word numbers of one language and makes runs of their suffixes."""

    def __init__(self) -> None:
        self.numbers = vocabulary()
        self.numbers[_BREAK]  # number 0 ends a piece
        self._empty()

    def _empty(self) -> None:
        self.codes, self.starts, self.size = [], [], 0

    def add(self, text: bytes) -> Iterator[tuple[int, int, bytes, bytes]]:
        marked = text.lower().translate(_ENDS).replace(b"\n", b" " + _BREAK + b" ")
        codes = numbered(marked, self.numbers)
        for at in range(0, len(codes), RUN_WORDS):
            # The words behind a cut complete the suffixes before it; they start none.
            part = codes[at : at + RUN_WORDS + DEPTH - 1]
            starts = part > 0
            starts[RUN_WORDS:] = False
            self.codes += [part, np.zeros(DEPTH, np.int32)]
            self.starts += [starts, np.zeros(DEPTH, bool)]
            self.size += len(part)
            if self.size >= RUN_WORDS:
                yield from self.run()
        if not self.size:
            self.__init__()

    def run(self) -> Iterator[tuple[int, int, bytes, bytes]]:
        if self.size:
            codes = np.concatenate(self.codes).astype(np.int64)
            at = np.flatnonzero(np.concatenate(self.starts))
            suffixes = np.stack([codes[at + k] for k in range(DEPTH)], axis=1)
            for k in range(1, DEPTH):
                suffixes[suffixes[:, k - 1] == 0, k] = 0
            if len(at):
                words = list(self.numbers)[1:]
                yield _packed(words, *_distinct(suffixes))
        self._empty()


def leaf_runs(docs: DataFrame) -> DataFrame:
    """Runs of the truncated suffixes of ``docs (lang, text)``, as _RUN has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sorters: dict[str, _Sorter] = {}
        names = [part.split()[0] for part in _RUN.split(", ")]

        def row(lang, packed):
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in (lang, *packed)], names)

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                sorter = sorters.setdefault(lang, _Sorter())
                for packed in sorter.add(text.as_py()):
                    yield row(lang, packed)
            # Many languages side by side must not keep more than a run's words.
            if sum(s.size for s in sorters.values()) >= RUN_WORDS:
                for lang, sorter in sorters.items():
                    for packed in sorter.run():
                        yield row(lang, packed)
                sorters.clear()
        for lang, sorter in sorters.items():
            for packed in sorter.run():
                yield row(lang, packed)

    rows = docs.select(
        F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    return rows.mapInArrow(run, _RUN)


def _local_keys(words: list[bytes], prefixes: set[bytes], length: int) -> np.ndarray:
    """``prefixes`` of ``length`` words as rows of word numbers, as far as ``words`` has them."""
    index = {word: k for k, word in enumerate(words, 1)}
    found = [[index.get(w, 0) for w in p.split(b" ")] for p in prefixes]
    rows = np.array([f for f in found if all(f)], np.int64)
    return rows.reshape(-1, length)


def _below(suffixes: np.ndarray, words: list[bytes], prefixes: set[bytes], length: int) -> np.ndarray:
    """Which of ``suffixes`` begin with one of ``prefixes`` of ``length`` words."""
    keys = _local_keys(words, prefixes, length)
    if not len(keys):
        return np.zeros(len(suffixes), bool)
    both = np.concatenate([keys, suffixes[:, :length]])
    number = both[:, 0]
    for k in range(1, length):
        # Numbers of pairs, then of triples: small enough to be paired again.
        number = np.unique(number << 32 | both[:, k], return_inverse=True)[1]
    return np.isin(number[len(keys) :], number[: len(keys)])


def _prefix_counts(runs: DataFrame, length: int, parents: dict[str, set[bytes]]) -> DataFrame:
    """``lang, phrase, leaves, f`` of the prefixes of ``length`` words below ``parents``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, (words, suffixes, counts) in _unpacked_rows(batches):
            wanted = suffixes[:, length - 1] > 0
            if length > 1:
                wanted &= _below(suffixes, words, parents.get(lang, set()), length - 1)
            suffixes, counts = suffixes[wanted, :length], counts[wanted]
            if not len(counts):
                continue
            # Runs are sorted, so equal prefixes stand together.
            new = np.ones(len(counts), bool)
            new[1:] = (suffixes[1:] != suffixes[:-1]).any(axis=1)
            at = np.flatnonzero(new)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * len(at)),
                    pa.array(_texts(words, suffixes[at]), pa.binary()).cast(pa.string()),
                    pa.array(np.diff(np.append(at, len(counts)))),
                    pa.array(np.add.reduceat(counts, at)),
                ],
                ["lang", "phrase", "leaves", "f"],
            )

    counted = runs.mapInArrow(run, "lang string, phrase string, leaves long, f long")
    return counted.groupBy("lang", "phrase").agg(F.sum("leaves").alias("leaves"), F.sum("f").alias("f"))


def _texts(words: list[bytes], suffixes: np.ndarray) -> list[bytes]:
    """The words of each row, joined by one space; 0 is no word."""
    table = [b"", *words]
    return [b" ".join([table[w] for w in row if w]) for row in suffixes.tolist()]


def _partition(runs: DataFrame) -> tuple[DataFrame, list[DataFrame], list[dict[str, set[bytes]]], int]:
    """Vertical partitioning: counts of words, counts and prefixes that are extended by
    length, and the number of groups."""
    words = written(_prefix_counts(runs, 1, {}))
    total = words.agg(F.sum("leaves")).first()[0] or 0
    most = max(GROUP_LEAVES // PREFIX_PART, total // MOST_EXTENDED)
    extended: list[dict[str, set[bytes]]] = []
    counts = [words]
    for length in range(1, DEPTH):
        if length > 1:
            counts.append(written(_prefix_counts(runs, length, extended[-1])))
        found: dict[str, set[bytes]] = {}
        for lang, phrase in counts[-1].where(F.col("leaves") > most).select("lang", "phrase").collect():
            found.setdefault(lang, set()).add(phrase.encode())
        if not found:
            break
        extended.append(found)
    # Groups that are half full on average leave room for what falls together.
    return words, counts[1:], extended, max(1, -(-2 * total // GROUP_LEAVES))


def _dealt(runs: DataFrame, extended: list[dict[str, set[bytes]]], groups: int) -> DataFrame:
    """The runs cut by group, with a column ``group_no``."""
    known = runs.sparkSession.sparkContext.broadcast(extended)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, (words, suffixes, counts) in _unpacked_rows(batches):
            marks = np.array([0, *map(zlib.crc32, words)], np.uint64)
            start = np.uint64(zlib.crc32(lang.encode()))
            hashed = _mixed(start, marks[suffixes[:, 0]])
            for length, prefixes in enumerate(known.value, 1):
                longer = _below(suffixes, words, prefixes.get(lang, set()), length)
                hashed[longer] = _mixed(hashed[longer], marks[suffixes[longer, length]])
            group = (hashed % np.uint64(groups)).astype(np.int64)
            order = np.argsort(group, kind="stable")
            at = np.flatnonzero(np.diff(group[order], prepend=-1))
            for begin, end in zip(at, np.append(at[1:], len(order))):
                part = order[begin:end]
                used, local = np.unique(suffixes[part], return_inverse=True)
                own = [words[w - 1] for w in used.tolist() if w]
                shift = 0 if used[0] == 0 else 1
                packed = _packed(own, local.reshape(-1, DEPTH) + shift, counts[part])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x]) for x in (int(group[part[0]]), lang, *packed)],
                    ["group_no", "lang", "leaves", "vocabulary_bytes", "vocabulary", "suffixes"],
                )

    return runs.mapInArrow(run, f"group_no long, {_RUN}")


def _mixed(seed, value: np.ndarray) -> np.ndarray:
    """A 64-bit hash of two."""
    with np.errstate(over="ignore"):
        x = (seed ^ value) * np.uint64(0x9E3779B97F4A7C15)
        return (x ^ x >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(3)


def _subtree_nodes(
    dealt: DataFrame, extended: list[dict[str, set[bytes]]], min_count: int
) -> DataFrame:
    """``lang, phrase, f`` of the nodes of 2 to DEPTH words that lie in one subtree."""
    known = dealt.sparkSession.sparkContext.broadcast(extended)

    def build(table: pa.Table) -> pa.Table:
        columns = [table.column(k).to_pylist() for k in range(1, 6)]
        out: dict[str, list] = {"lang": [], "phrase": [], "f": []}
        for lang in sorted(set(columns[0])):
            numbers, suffixes, counts = vocabulary(), [], []
            numbers[_BREAK]
            for other, *packed in zip(*columns):
                if other == lang:
                    words, rows, times = _unpacked(*packed)
                    codes = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
                    suffixes.append(np.append(0, codes)[rows])
                    counts.append(times)
            words = list(numbers)[1:]
            leaves, totals = _distinct(np.concatenate(suffixes), np.concatenate(counts))
            new = np.zeros(len(leaves), bool)
            new[0] = True
            for length in range(1, DEPTH + 1):
                new[1:] |= leaves[1:, length - 1] != leaves[:-1, length - 1]
                if length == 1:
                    continue
                at = np.flatnonzero(new)
                f = np.add.reduceat(totals, at)
                node = (leaves[at, length - 1] > 0) & (f >= min_count)
                rows = leaves[at[node], :length]
                phrases, f = _texts(words, rows), f[node].tolist()
                above = known.value[length - 1].get(lang, set()) if length <= len(known.value) else set()
                for phrase, n in zip(phrases, f):
                    if phrase not in above:
                        out["lang"].append(lang)
                        out["phrase"].append(phrase)
                        out["f"].append(n)
        return pa.table(
            [
                pa.array(out["lang"], pa.string()),
                pa.array(out["phrase"], pa.binary()).cast(pa.string()),
                pa.array(out["f"], pa.int64()),
            ],
            names=list(out),
        )

    return dealt.groupBy("group_no").applyInArrow(build, "lang string, phrase string, f long")


def phrase_counts(docs: DataFrame, min_count: int = MIN_COUNT) -> tuple[DataFrame, DataFrame]:
    """``lang, phrase, f`` of all phrases of 1 to DEPTH words that occur ``min_count`` times
    or more in ``docs (lang, text)``, and ``lang, n``, the number of words of each language.

    Pieces, words and the treatment of nulls are those of ``mine``.
    """
    runs = written(leaf_runs(docs))
    words, longer, extended, groups = _partition(runs)
    nodes = _subtree_nodes(_dealt(runs, extended, groups), extended, min_count)
    for length, counts in enumerate(longer, 2):
        if length <= len(extended):
            phrases = [(lang, p.decode()) for lang, all_of in extended[length - 1].items() for p in all_of]
            above = counts.sparkSession.createDataFrame(phrases, "lang string, phrase string")
            known = counts.join(above, ["lang", "phrase"], "left_semi")
            nodes = nodes.unionByName(known.where(F.col("f") >= min_count).select("lang", "phrase", "f"))
    frequent = words.where(F.col("f") >= min_count).select("lang", "phrase", "f")
    return written(nodes.unionByName(frequent)), words.groupBy("lang").agg(F.sum("f").alias("n"))


def _part(words: Column, start: int | Column, length: int | Column) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def _whole(name: str) -> Column:
    """A long as a decimal, whose products are exact."""
    return F.col(name).cast("decimal(20,0)")


def mine(docs: DataFrame, min_count: int = MIN_COUNT, top: int = TOP) -> DataFrame:
    """Collocations of each language: ``lang, rank, phrase, a, l, r, n, score``.

    Texts of ``docs (lang, text)`` are lower-cased in A-Z, cut into pieces at ``.,;:!?`` and
    0x0A-0x0D, and these into words at space and tab. Phrases of 2 to DEPTH words with a =
    f(phrase) >= ``min_count`` are candidates. Of the cuts into a first part (l) and a rest
    (r) the one with the lowest floor(2000000 * a / (l + r)) counts, of equal ones the first.
    A candidate is dropped if a longer one that contains its words has COVER_PERCENT percent
    of its count or more. The ``top`` best by score, a, phrase (bytes) are returned.

    A null lang is the language ``und``, a null text an empty one. Texts of any length are
    read whole; a phrase never spans two texts, so repeated rows simply count again. Without
    candidates, or rows, there is no row. Other columns of ``docs`` are not looked at.
    """
    counts, sizes = phrase_counts(docs, min_count)
    words = F.split("phrase", " ")
    candidates = counts.select("lang", "phrase", F.col("f").alias("a"), F.size(words).alias("m")).where("m > 1")
    cuts = candidates.select(
        "lang", "phrase", "a", words.alias("w"), "m", F.explode(F.sequence(F.lit(1), F.col("m") - 1)).alias("k")
    ).select(
        "lang", "phrase", "a", "k",
        _part(F.col("w"), 1, F.col("k")).alias("first"),
        _part(F.col("w"), F.col("k") + 1, F.col("m") - F.col("k")).alias("rest"),
    )
    first = counts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    rest = counts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    joined = cuts.join(first, ["lang", "first"]).join(rest, ["lang", "rest"])
    ratio = (F.lit(2_000_000).cast("decimal(7,0)") * _whole("a")).alias("product")
    cut = (
        joined.select("*", ratio, (_whole("l") + _whole("r")).alias("parts"))
        .withColumn("score", F.expr("product div parts"))
        .groupBy("lang", "phrase", "a")
        .agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    )

    longer = candidates.where("m > 2").select("a", "lang", words.alias("w"), "m")
    spans = F.flatten(
        F.transform(
            F.sequence(F.lit(2), F.col("m") - 1),
            lambda size: F.transform(
                F.sequence(F.lit(1), F.col("m") - size + 1), lambda at: _part(F.col("w"), at, size)
            ),
        )
    )
    inner = longer.select("lang", "a", F.explode(spans).alias("phrase"))
    covered = inner.groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    scored = (
        cut.join(covered, ["lang", "phrase"], "left")
        .where(F.col("most").isNull() | (100 * _whole("most") < COVER_PERCENT * _whole("a")))
        .select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    )
    best = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    # The best of each part of a language first, so that no task sorts all candidates of one.
    salted = scored.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(_SALTS)))
    parts = salted.withColumn("_rank", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*best)))
    ranked = parts.where(F.col("_rank") <= top).withColumn(
        "rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")
    )
    return ranked.where(F.col("rank") <= top).join(sizes, "lang").select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score"
    )
