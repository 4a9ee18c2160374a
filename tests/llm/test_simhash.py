from __future__ import annotations

import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
import xxhash
from samples import edge_docs, edge_rows, empty_docs, with_clashing_columns

from envtally.llm import simhash


def brute_fingerprint(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    counts = Counter(b for h in hashes for b in range(64) if h >> b & 1)
    return sum(1 << b for b, n in counts.items() if 2 * n > len(hashes))


def brute_components(values):
    """value -> smallest value reachable over at most 4 differing bits."""
    values = sorted(set(values))
    parent = {v: v for v in values}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in combinations(values, 2):
        if bin(a ^ b).count("1") <= 4:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    return {v: root(v) for v in values}


def brute(rows):
    fps = [brute_fingerprint(r[1]) for r in rows]
    component = brute_components(fps)
    ids = defaultdict(list)
    for r, fp in zip(rows, fps):
        ids[component[fp]] += [r[0]] if r[0] is not None else []
    return [(r[0], f"{fp:016x}", min(ids[component[fp]], default=None)) for r, fp in zip(rows, fps)], fps, component


def test_blocks_meet_every_four_positions():
    assert len(simhash.BLOCKS) == 20
    for four in combinations(range(8), 4):
        assert any(set(b) <= set(four) for b in simhash.BLOCKS)


def test_near_duplicates_equal_brute_force(spark):
    got = simhash.near_duplicates(with_clashing_columns(edge_docs(spark))).collect()
    assert Counter(map(tuple, got)) == Counter(brute(edge_rows())[0])
    assert simhash.near_duplicates(empty_docs(spark)).collect() == []


@pytest.mark.parametrize("chunk", [5, 4096])
def test_links_connect_what_brute_force_connects(spark, monkeypatch, chunk):
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    rng = random.Random(3)
    centres = [rng.getrandbits(64) for _ in range(40)]
    values = set(centres)
    for _ in range(700):
        v = rng.choice(centres[:4])
        for _ in range(rng.randint(0, 6)):
            v ^= 1 << rng.randrange(64)
        values.add(v)
    signed = [int(np.uint64(v).astype(np.int64)) for v in values]
    edges = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long")).collect()
    found = {v: v for v in values}

    def root(v):
        while found[v] != v:
            v = found[v]
        return v

    for u, v in edges:
        u, v = (x % (1 << 64) for x in (u, v))
        a, b = sorted((root(u), root(v)))
        found[b] = a
    assert {v: root(v) for v in values} == brute_components(values)


def test_deduplicate_keeps_one_of_each_component(spark):
    docs = with_clashing_columns(edge_docs(spark))
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns
    rows = edge_rows()
    _, fps, component = brute(rows)
    wanted = {}
    for r, fp in zip(rows, fps):
        key = (r[0] is None, r[0] or 0)
        wanted[component[fp]] = min(wanted.get(component[fp], key), key)
    got = [(r.doc_id is None, r.doc_id or 0) for r in kept.collect()]
    assert sorted(got) == sorted(wanted.values())
    assert simhash.deduplicate(empty_docs(spark)).collect() == []
