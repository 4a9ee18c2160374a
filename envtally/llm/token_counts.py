"""Token counts under a unigram model, by dynamic programming over a trie of pre-tokens.

The distinct pre-tokens of some texts are inserted in a trie. The forward score of a node is
the best sum of piece scores over all ways to cut the bytes from the root to it. It depends
on nothing else, so pre-tokens with a common prefix share it. The trie is built level by
level, all its nodes of a level at once; so are the scores. A node on which a pre-token ends
gives its number of tokens.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from envtally.llm.pretokens import read_ranks, splitter

#: Pre-tokens, repeats counted, after which a trie is complete.
TRIE_TOKENS = 1 << 17
#: Pre-tokens whose counts a task keeps; then it starts anew.
CACHE = 1 << 18


def zipf_scores(ranks: dict[bytes, int]) -> dict[bytes, float]:
    """Log probabilities after Zipf's law: a piece is as frequent as 1 / (rank + 1)."""
    places = np.array(list(ranks.values()), float) + 1
    return dict(zip(ranks, (-np.log(places) - np.log((1 / places).sum())).tolist()))


def automaton(scores: dict[bytes, float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pieces: sorted keys (state * 256 + byte), their next states, scores of states.

    A byte that is no piece becomes one, with a score below all others.
    """
    least = min(scores.values(), default=0.0)
    scores = {bytes([b]): least - 10.0 for b in range(256)} | scores
    step: dict[int, int] = {}
    score = [-np.inf]
    for piece, value in scores.items():
        state = 0
        for byte in piece:
            key = state << 8 | byte
            if key not in step:
                step[key] = len(score)
                score.append(-np.inf)
            state = step[key]
        if state:
            score[state] = value
    keys = np.fromiter(step, np.int64, len(step))
    order = np.argsort(keys)
    return keys[order], np.fromiter(step.values(), np.int64, len(step))[order], np.array(score)


def count_tokens(tokens: Sequence[bytes], pieces: tuple) -> np.ndarray:
    """The number of tokens of each of ``tokens``, which must be distinct, sorted, not empty.

    Of cuts with equal scores the one with the fewest tokens counts.
    """
    keys, next_, scores = pieces
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
    data = np.frombuffer(b"".join(tokens), np.uint8).astype(np.int64)
    begin = np.cumsum(lengths) - lengths
    best = np.full(len(data) + 1, -np.inf)
    number = np.zeros(len(data) + 1, np.int64)
    best[0] = 0.0
    counts = np.zeros(len(tokens), np.int64)
    # Matches that have begun at a node above and can go on, grouped by the node they reached.
    first, size = np.zeros(1, np.int64), np.ones(1, np.int64)
    start, state = np.zeros(1, np.int64), np.zeros(1, np.int64)
    active, node, level_base, nodes = np.arange(len(tokens)), np.zeros(len(tokens), np.int64), 0, 1
    depth = 0
    while len(active):
        byte = data[begin[active] + depth]
        new = np.ones(len(active), bool)
        new[1:] = (node[1:] != node[:-1]) | (byte[1:] != byte[:-1])
        parent, label = node[new] - level_base, byte[new]
        node = nodes + np.cumsum(new) - 1
        # The matches of each new node are those of its parent, one byte longer.
        many = size[parent]
        ends = np.cumsum(many)
        at = np.arange(ends[-1]) + np.repeat(first[parent] - (ends - many), many)
        owner = np.repeat(np.arange(len(parent)), many)
        key = state[at] << 8 | label[owner]
        place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        alive = keys[place] == key
        owner, from_, to = owner[alive], start[at[alive]], next_[place[alive]]
        # A match that spells a piece is a way to reach the node; single bytes always do.
        score = best[from_] + scores[to]
        group = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        top = np.maximum.reduceat(score, group)
        fewest = np.where(score == top[owner], number[from_] + 1, np.iinfo(np.int64).max)
        best[nodes : nodes + len(parent)] = top
        number[nodes : nodes + len(parent)] = np.minimum.reduceat(fewest, group)
        # A new match begins at each node; it goes last in the node's group.
        kept = np.bincount(owner, minlength=len(parent))
        size = kept + 1
        first = np.cumsum(size) - size
        old = np.arange(len(owner)) + owner
        start = np.empty(len(owner) + len(parent), np.int64)
        state = np.zeros(len(start), np.int64)
        start[old], state[old] = from_, to
        start[first + kept] = nodes + np.arange(len(parent))
        depth += 1
        over = lengths[active] == depth
        counts[active[over]] = number[node[over]]
        active, node, level_base, nodes = active[~over], node[~over], nodes, nodes + len(parent)
    return counts


def token_counts(docs: DataFrame, keys: Sequence[str], ranks_path: str, pattern: str) -> DataFrame:
    """``keys`` of each row of ``docs``, ``n_pre_tokens`` and ``n_tokens`` (long) of its text.

    A null text has none. Rows stay as they are: repeated ones repeat, null keys stay null,
    columns besides the keys and ``text`` are not read. The driver reads the vocabulary; its
    automaton, of fixed size, is broadcast.
    """
    pieces = docs.sparkSession.sparkContext.broadcast(automaton(zipf_scores(read_ranks(ranks_path))))
    names = [*keys, "n_pre_tokens", "n_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, known = splitter(pattern), {}

        def numbers(parts: list[list[str]]) -> list[int]:
            new = set().union(*parts).difference(known)
            if len(known) + len(new) > CACHE:
                known.clear()
                new = set().union(*parts)
            if new:
                tokens = sorted(t.encode() for t in new)
                counts = count_tokens(tokens, pieces.value).tolist()
                known.update(zip((t.decode() for t in tokens), counts))
            return [sum(map(known.__getitem__, part)) for part in parts]

        for batch in batches:
            texts = batch.column(len(keys))
            pre, total = np.zeros((2, len(texts)), np.int64)
            rows, parts, size = [], [], 0
            for row in range(len(texts)):
                for part in split(texts[row].as_py() or ""):
                    pre[row] += len(part)
                    rows.append(row)
                    parts.append(part)
                    size += len(part)
                    if size > TRIE_TOKENS:
                        np.add.at(total, rows, numbers(parts))
                        rows, parts, size = [], [], 0
            if parts:
                np.add.at(total, rows, numbers(parts))
            columns = [batch.column(k) for k in range(len(keys))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(pre), pa.array(total)], names)

    rows = docs.select(*keys, F.col("text").cast("string").alias("text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keys).schema)
    return rows.mapInArrow(run, f"{kinds}, n_pre_tokens long, n_tokens long")
