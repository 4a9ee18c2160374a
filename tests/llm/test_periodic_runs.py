from __future__ import annotations

import hashlib
import os
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from samples import edge_docs, edge_rows, empty_docs, with_clashing_columns

from envtally.llm import periodic_runs, queries

SF_DIR = "/root/testdata/sf0.001"


def brute_runs(s, min_length=6, min_exponent=4):
    """(start, length, period) of maximal stretches, by trying every period from 1 on."""
    out = {}
    for q in range(1, len(s) // min_exponent + 1):
        i = 0
        while i + q < len(s):
            if s[i] != s[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(s) and s[j] == s[j + q]:
                j += 1
            if j + q - i >= max(min_length, min_exponent * q):
                out.setdefault((i, j + q - i), q)
            i = j
    return sorted((i, n, q) for (i, n), q in out.items())


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def collapsed(words, runs):
    gone = {i for a, n, q in runs for i in range(a + q, a + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def expected(doc_id, text):
    words = words_of(text)
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    lines = "".join(f"{a},{m},{q}\n" for a, m, q in runs)
    return (
        doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
        hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(collapsed(words, runs).encode()).hexdigest(),
    )


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=70), st.integers(1, 12), st.sampled_from([(6, 4), (2, 2), (5, 3)]))
def test_find_runs_equals_brute_force(symbols, period, least):
    for s in (symbols, [symbols[i % period] for i in range(len(symbols)) if i % period < len(symbols)]):
        got = periodic_runs.find_runs(np.array([*s, 9]), *least)
        assert [tuple(r) for r in got.tolist()] == brute_runs(s, *least)


def test_nearest_smaller_over_stairs():
    rng = np.random.default_rng(1)
    for values in (np.arange(5000), np.arange(5000)[::-1], np.zeros(5000, int), rng.integers(0, 9, 5000), np.tile(np.arange(700), 7)):
        low = np.concatenate([[-1], values]).astype(np.int32)
        got = periodic_runs.nearest_smaller(low)
        stack, wanted = [0], []
        for i in range(1, len(low)):
            while low[stack[-1]] >= low[i]:
                stack.pop()
            wanted.append(stack[-1])
            stack.append(i)
        assert got[1:].tolist() == wanted


@pytest.mark.parametrize("batch", [20, 1 << 18])
def test_operator_over_edge_rows(spark, monkeypatch, batch):
    monkeypatch.setattr(periodic_runs, "BATCH_WORDS", batch)
    docs = with_clashing_columns(edge_docs(spark))
    rows = periodic_runs.periodic_runs(docs, ["doc_id", "n_chars", "words"]).collect()
    got = sorted(((r.doc_id, r.n_chars, [tuple(x) for x in r.runs], r.collapsed) for r in rows), key=str)
    wanted = []
    for doc_id, text, _, _, n_chars in edge_rows():
        # The long texts are prose, whose runs are found over a few periods.
        words = words_of(text)
        runs = brute_runs(words) if len(words) < 2000 else short_runs(words)
        wanted.append((doc_id, n_chars, runs, collapsed(words, runs)))
    assert got == sorted(wanted, key=str)
    assert periodic_runs.periodic_runs(empty_docs(spark), ["doc_id"]).collect() == []


def short_runs(words):
    """Runs of long random prose: those of periods up to 50."""
    out = {}
    for q in range(1, 51):
        same = [words[i] == words[i + q] for i in range(len(words) - q)] + [False]
        i = 0
        while i < len(same):
            j = i
            while same[j]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q):
                out.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted((i, n, q) for (i, n), q in out.items())


def test_one_very_long_repetition():
    """Suffixes share up to all words here; the search stays n log n."""
    rng = random.Random(2)
    block = [rng.randrange(1000) for _ in range(97)]
    s = np.array([5000, *(block * 3000)[:-11], 6000, 9999])
    assert periodic_runs.find_runs(s).tolist() == [[1, 97 * 3000 - 11, 97]]


def test_planted_and_digests_over_edge_rows(spark, tmp_path):
    rows = [(n, f"w{n % 7} x y " * (n % 50) + "end", "en", "a", 0) for n in range(300)] + [r for r in edge_rows() if len(r[1] or "") < 5000]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op12_periodic_runs"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=str) == sorted((expected(r[0], r[1]) for r in rows), key=str)


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")
def test_query_equals_brute_force(spark):
    rows = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    got = queries.QUERIES["op12_periodic_runs"](spark, SF_DIR).collect()
    assert sorted(map(tuple, got)) == sorted(expected(*r) for r in rows)
    assert sum(r[1] > 0 for r in got) > 5
