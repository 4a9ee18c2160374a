from __future__ import annotations

import numpy as np
import pytest

from envtally.llm import ann

SCHEMA = "vec_id long, embedding array<float>, rank int, score string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, "clash") for i, v in rows], SCHEMA).repartition(4)


def brute(rows, most=20):
    good = {}
    for i, v in rows:
        if i is not None and v and None not in v and np.isfinite(v).all() and any(v):
            good.setdefault(i, np.array(v, np.float32).astype(float))
    out = []
    for q, v in good.items():
        if q % 20 == 0:
            near = sorted((-float((v * w).sum()), i) for i, w in good.items() if i != q and len(w) == len(v))
            out += [(q, rank, i, -s) for rank, (s, i) in enumerate(near[:most], 1)]
    return sorted(out)


def same(got, expected):
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got)
    assert [g[:3] for g in got] == [e[:3] for e in expected]
    assert [g[3] for g in got] == pytest.approx([e[3] for e in expected], abs=1e-12)


def edge_rows():
    rng = np.random.default_rng(1)
    rows = [(n, rng.integers(-4, 5, 6).astype(float).tolist()) for n in range(300)]
    common = [1.0, 2.0, 0.0, 0.0, 0.0, 1.0]
    rows += [(n, common) for n in range(400, 700)]
    rows += [(1000, None), (1020, []), (1040, [0.0] * 6), (1060, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (1080, [float("nan")] + common[1:])]
    rows += [(1100, [float("inf")] + common[1:]), (None, common), (1120, [1.0, 2.0]), (1140, [2.0, 1.0]), (1160, [7.0])]
    rows += [(-20, [-0.0, 1.0, 0.0, 0.0, 0.0, 0.0]), (-19, [0.0, 1.0, 0.0, 0.0, 0.0, 0.0]), (20, rows[20][1])]
    return rows


def test_edge_cases_equal_brute_force(spark, monkeypatch):
    """With certainty asked for, all trees ascend to their roots, and the result is exact."""
    rows = edge_rows()
    with monkeypatch.context() as m:
        m.setattr(ann, "FOUND", 1.0)
        same(ann.search(table(spark, rows)).collect(), brute(rows))
    found = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in ann.search(table(spark, rows)).collect())
    expected = brute(rows)
    assert [f[:2] for f in found] == [e[:2] for e in expected]
    assert all(f[3] <= e[3] + 1e-12 for f, e in zip(found, expected))
    assert sum(f[3] == pytest.approx(e[3], abs=1e-12) for f, e in zip(found, expected)) >= 0.9 * len(expected)
    assert ann.search(table(spark, rows).limit(0)).collect() == []
    assert ann.search(table(spark, [(1, [1.0]), (2, [0.0])])).collect() == []


def test_fewer_candidates_than_neighbours(spark):
    rows = [(n, [float(n), 1.0]) for n in range(15)]
    got = ann.search(table(spark, rows)).collect()
    assert len(got) == 14
    same(got, brute(rows))


@pytest.mark.parametrize("clustered", [False, True])
def test_recall_over_many_cells(spark, monkeypatch, clustered):
    """Cells far smaller than in production, so that queries depend on prefixes and cuts."""
    monkeypatch.setattr(ann, "CELL", 300)
    monkeypatch.setattr(ann, "CELL_PER_ROOT", 4)
    rng = np.random.default_rng(2)
    vectors = rng.standard_normal((3000, 16))
    if clustered:
        vectors = rng.standard_normal((30, 16))[rng.integers(0, 30, 3000)] * 2 + 0.3 * vectors
    vectors *= rng.uniform(0.5, 2.0, (3000, 1))
    rows = [(n, v) for n, v in enumerate(vectors.astype(np.float32).tolist())]
    got = ann.search(table(spark, rows)).collect()
    expected = brute(rows)
    assert len(got) == len(expected)
    found = {(r.query_id, r.vec_id) for r in got}
    assert sum((e[0], e[2]) in found for e in expected) / len(expected) >= 0.9
    by_pair = {(e[0], e[2]): e[3] for e in expected}
    assert all(by_pair[q, i] == pytest.approx(s) for q, _, i, s in map(tuple, got) if (q, i) in by_pair)


def test_pieces_cut_through_equal_hashes():
    cut = (np.array([5, 5, 9], np.uint64), np.array([10, 20, 1]))
    found = np.array([4, 5, 5, 5, 5, 8, 9, 9, 10], np.uint64)
    reps = np.array([99, 9, 10, 19, 20, 0, 0, 1, 0])
    assert ann._pieces(found, reps, cut).tolist() == [0, 0, 1, 1, 2, 2, 2, 3, 3]


def test_ranges_share_prefixes():
    rng = np.random.default_rng(3)
    found = np.sort(rng.integers(0, 1 << 63, 500).astype(np.uint64) * np.uint64(2) + rng.integers(0, 2, 500).astype(np.uint64))
    asked = np.concatenate([found[:20], rng.integers(0, 1 << 63, 20).astype(np.uint64)])
    for level in (0, 1, 5, 9, 63, 64):
        low, high = ann._ranges(found, asked, level)
        for a, lo, hi in zip(asked.tolist(), low, high):
            shares = [(a ^ f) >> (64 - level) == 0 if level else True for f in found.tolist()]
            assert np.flatnonzero(shares).tolist() == list(range(lo, hi))


def recall(spark, monkeypatch, vectors, asked=None, cell=300, budget=4):
    """Of the neighbours of the queries ``asked``, or of all, the share found; cells and first look are small."""
    monkeypatch.setattr(ann, "CELL", cell)
    monkeypatch.setattr(ann, "CELL_PER_ROOT", 1)
    monkeypatch.setattr(ann, "BUDGET", budget)
    vectors = vectors.astype(np.float32)
    rows = table(spark, list(enumerate(vectors.tolist())))
    got = {}
    for r in ann.search(rows).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    whole = vectors.astype(float)
    shares = []
    for q in range(0, len(whole), 20) if asked is None else asked:
        scores = whole @ whole[q]
        scores[q] = -np.inf
        shares.append(len(got[q] & set(np.argsort(-scores, kind="stable")[:20].tolist())) / 20)
    return np.mean(shares)


def unit(vectors):
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def test_an_ascent_meets_what_it_must():
    cosine = np.linspace(-1, 1, 2001)
    levels = ann.ascent(cosine)
    assert levels.shape == (2001, ann.TREES) and levels[-1].min() == ann.BITS
    shares = 1 - np.arccos(cosine) / np.pi
    missed = np.where(levels < 0, 1.0, 1 - shares[:, None] ** np.maximum(levels, 0))
    assert (1 - missed.prod(axis=1) >= ann.FOUND - 1e-9).all()
    # All trees ascend together: no two are more than a level apart, but where one is at its root.
    below = levels[levels[:, 0] > 0]
    assert (below.max(axis=1) - below.min(axis=1) <= 1).all()
    assert levels[cosine > 0.999].min() > 10 and levels[cosine < -0.999].max() == 0


def test_a_descent_ends_beside_the_longest_prefixes():
    rng = np.random.default_rng(8)
    found = np.sort(rng.integers(0, 1 << 63, 500).astype(np.uint64) * np.uint64(2))
    asked = rng.integers(0, 1 << 63, 40).astype(np.uint64) * np.uint64(2)
    low, high = ann._descent(found, asked, np.full(40, 6))
    for a, lo, hi in zip(asked.tolist(), low, high):
        shared = [64 - (a ^ f).bit_length() for f in found.tolist()]
        assert max(shared) in shared[lo:hi] and 3 <= hi - lo <= 6
    assert ann._descent(found[:0], asked, np.full(40, 6))[1].max() == 0


def test_the_share_of_vectors_scored_falls(spark):
    """With the constants of production, for random directions and for clusters."""
    rng = np.random.default_rng(9)
    for spread in (None, 0.4):
        shares = []
        for n in (1000, 4000, 16_000):
            vectors = rng.standard_normal((n, 32))
            if spread:
                vectors = rng.standard_normal((n // 25, 32))[rng.integers(0, n // 25, n)] + spread * vectors
            rows = table(spark, list(enumerate(unit(vectors).tolist())))
            scored = [r.scored for r in ann.scored_pairs(rows).collect()]
            assert len(scored) == n // 20
            shares.append(np.mean(scored) / n)
        assert shares[0] > shares[1] > shares[2]
        assert not spread or shares[2] < shares[0] / 2


def test_recall_with_the_constants_of_production(spark, monkeypatch):
    rng = np.random.default_rng(10)
    for n in (500, 9000):
        assert recall(spark, monkeypatch, unit(rng.standard_normal((n, 64))), cell=ann.CELL, budget=ann.BUDGET) >= 0.9


def test_recall_does_not_fall_with_the_size(spark, monkeypatch):
    rng = np.random.default_rng(4)
    for n in (2000, 20_000):
        assert recall(spark, monkeypatch, unit(rng.standard_normal((n, 12)))) >= 0.9


def test_a_third_of_the_rows_in_one_near_equal_cluster(spark, monkeypatch):
    rng = np.random.default_rng(5)
    vectors = unit(rng.standard_normal((6000, 32)))
    near = rng.permutation(6000)[:2000]
    vectors[near] = unit(vectors[0] + 0.002 / 32**0.5 * rng.standard_normal((2000, 32)))
    assert recall(spark, monkeypatch, vectors, [q for q in near.tolist() if q % 20 == 0]) >= 0.9


def test_a_few_long_vectors_and_short_ones(spark, monkeypatch):
    rng = np.random.default_rng(6)
    vectors = unit(rng.standard_normal((6000, 12)))
    vectors[[7, 3000, 4001]] *= [[100.0], [10.0], [3.0]]
    vectors[100:200] *= 1e-3
    assert recall(spark, monkeypatch, vectors) >= 0.9
