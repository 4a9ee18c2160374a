from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest
from samples import DOCS, edge_docs, edge_rows, empty_docs, prose, with_clashing_columns

from envtally.llm import mixing


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def brute_targets(sizes):
    """source -> target, from source -> words, with the excess reshared until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[n % 3] for n, s in enumerate(names)}
    target, stopped = dict.fromkeys(names, 0.0), set()
    rest = 1.5 * sum(sizes.values())
    while rest > 1e-9 and len(stopped) < len(names):
        open_ = [s for s in names if s not in stopped]
        total, given = sum(weight[s] for s in open_), rest
        rest = 0.0
        for s in open_:
            target[s] += given * weight[s] / total
            if target[s] >= 2 * sizes[s]:
                rest += target[s] - 2 * sizes[s]
                target[s] = 2.0 * sizes[s]
                stopped.add(s)
    return target


def source_sizes(rows):
    out = defaultdict(int)
    for r in rows:
        out[r[3]] += size(r[1])
    return out


def check(rows, got, near):
    sizes = source_sizes(rows)
    targets = brute_targets(sizes)
    taken, longest = defaultdict(int), defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(targets[r.source])
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 2
        taken[r.source] += r.taken
        longest[r.source] = max(longest[r.source], r.size)
    for source, target in targets.items():
        assert abs(taken[source] - target) <= near(source, longest[source]), source


def test_edge_cases(spark):
    docs = with_clashing_columns(edge_docs(spark))
    got = mixing.mix(docs).collect()
    rows = edge_rows()
    assert Counter((r.doc_id, r.source, r.size) for r in got) == Counter((r[0], r[3], size(r[1])) for r in rows)
    check(rows, got, lambda _, longest: longest)
    assert mixing.mix(empty_docs(spark)).collect() == []


def test_taken_words_are_near_the_targets(spark):
    rng = random.Random(8)
    rows = [(n, prose(rng, int(rng.paretovariate(1.1) * 5) % 3000 + 1), f"s{min(rng.randint(0, 30), 9)}", None, 0) for n in range(1500)]
    rows = [(i, t, "en", s, 0) for i, t, s, _, _ in rows]
    got = mixing.mix(spark.createDataFrame(rows, DOCS)).collect()
    sizes = source_sizes(rows)
    check(rows, got, lambda source, _: 0.002 * sizes[source])


def test_rates_are_exponential_in_the_size(spark):
    import math

    cells = [("a", n, 10) for n in (10, 20, 40, 80, 160, 320)]
    total = sum(n * k for _, n, k in cells)
    for share in (0.3, 1.6):
        sources = spark.createDataFrame([("a", total, share * total)], "source string, size long, target double")
        table = spark.createDataFrame(cells, "source string, size long, n long")
        rates = {r["size"]: r["rate"] for r in mixing.balance(table, sources).collect()}
        assert sum(10 * s * r for s, r in rates.items()) == pytest.approx(share * total, abs=1)
        logs = [math.log(r) / s for s, r in rates.items() if r < 2]
        assert max(logs) - min(logs) < 1e-6 * (1e-9 + abs(max(logs, key=abs)))


def test_one_size_in_two_sources_and_reruns_agree(spark):
    rows = [(n, "a b c", "en", "x" if n % 3 else "y", 0) for n in range(300)]
    got = mixing.mix(spark.createDataFrame(rows, DOCS)).collect()
    check(rows, got, lambda *_: 3)
    again = mixing.mix(spark.createDataFrame(rows[::-1], DOCS).repartition(7)).collect()
    assert sorted(again) == sorted(got)


def test_repeated_documents(spark):
    docs = with_clashing_columns(edge_docs(spark))
    got = mixing.repeat(docs)
    assert got.columns == docs.columns
    counts = Counter((r.doc_id, r.source, r.text) for r in got.collect())
    rows = edge_rows()
    most = Counter((r[0], r[3], r[1]) for r in rows)
    assert all(counts[key] <= 2 * most[key] for key in counts)
    assert all(counts[(r[0], r[3], r[1])] == most[(r[0], r[3], r[1])] for r in rows if not size(r[1]))
    taken = defaultdict(int)
    for (_, source, text), n in counts.items():
        taken[source] += n * size(text)
    targets = brute_targets(source_sizes(rows))
    for source, target in targets.items():
        assert abs(taken[source] - target) <= max(size(r[1]) for r in rows if r[3] == source)
    assert mixing.repeat(empty_docs(spark)).collect() == []


def test_an_unsolved_source_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MAX_ROUNDS", 1)
    sizes = [("a", 10, 5), ("a", 300, 2), ("b", 7, 40)]
    cells = spark.createDataFrame(sizes, "source string, size long, n long")
    sources = spark.createDataFrame([("a", 650, 900.0), ("b", 280, 100.0)], "source string, size long, target double")
    with pytest.raises(RuntimeError, match="after 1 rounds"):
        mixing.balance(cells, sources)
