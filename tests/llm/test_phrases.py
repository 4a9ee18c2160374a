from __future__ import annotations

import os
import random
import re
from collections import Counter, defaultdict

import pytest
from samples import edge_docs, edge_rows, empty_docs, with_clashing_columns

from envtally.llm import phrases, queries

SF_DIR = "/root/testdata/sf0.001"
COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def brute(rows, min_count=30, top=2000):
    """rows: (lang, text)."""
    counts, sizes = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            sizes[lang] += len(words)
            for size in range(1, 5):
                counts[lang].update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, f in counts.items():
        candidates = {p for p, a in f.items() if len(p) > 1 and a >= min_count}
        covered = set()
        for p in candidates:
            for size in range(2, len(p)):
                for i in range(len(p) - size + 1):
                    if 100 * f[p] >= 80 * f[p[i : i + size]]:
                        covered.add(p[i : i + size])
        best = []
        for p in candidates - covered:
            cuts = [(2_000_000 * f[p] // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            best.append((-score, -f[p], " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, rest) in enumerate(sorted(best)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, rest, sizes[lang], -score))
    return sorted(out)


def found(df):
    assert df.columns == list(COLUMNS)
    return sorted(map(tuple, df.collect()))


def pairs_of(rows):
    return [(lang, text) for _, text, lang, _, _ in rows]


@pytest.mark.parametrize("min_count", [2, 30])
def test_edge_rows_equal_brute_force(spark, min_count):
    docs = with_clashing_columns(edge_docs(spark))
    assert found(phrases.mine(docs, min_count)) == brute(pairs_of(edge_rows()), min_count)


def test_no_rows(spark):
    assert found(phrases.mine(empty_docs(spark))) == []
    assert found(phrases.mine(spark.createDataFrame([(None, None), ("en", " .\n")], "lang string, text string"))) == []


def test_small_budgets_cut_prefixes_and_runs(spark, monkeypatch):
    """Every length of prefix is extended, texts are cut into runs, groups hold few leaves."""
    rng = random.Random(5)
    rows = []
    for n in range(60):
        words = [rng.choice(["of", "of", "the", "a", "é", "über", "x" * rng.randint(1, 3)]) for _ in range(rng.randint(0, 400))]
        text = "".join(w + rng.choice([" ", " ", " ", "\t", ". ", ",", "\n"]) for w in words)
        rows.append((rng.choice(["en", "de", None]), text))
    monkeypatch.setattr(phrases, "RUN_WORDS", 100)
    monkeypatch.setattr(phrases, "GROUP_LEAVES", 64)
    extended = []
    partition = phrases._partition

    def seen(runs):
        result = partition(runs)
        extended.append([sum(map(len, level.values())) for level in result[2]])
        assert result[3] > 10
        return result

    monkeypatch.setattr(phrases, "_partition", seen)
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    assert found(phrases.mine(docs, 3, 50)) == brute(rows, 3, 50)
    assert len(extended[0]) == phrases.DEPTH - 1 and min(extended[0]) > 0


def test_cover_is_by_any_longer_candidate_and_exact(spark):
    """80 of 100 drop the shorter phrase, 79 of 100 don't, and a dropped one drops others."""
    rows = [("en", "p q r.") for _ in range(80)] + [("en", "p q.")] * 20 + [("fr", "p q r.")] * 79 + [("fr", "p q.")] * 21
    rows += [("de", "a b c d.")] * 40
    docs = spark.createDataFrame(rows, "lang string, text string")
    got = found(phrases.mine(docs))
    assert got == brute(rows)
    assert [(r[0], r[2]) for r in got] == [("de", "a b c d"), ("en", "p q r"), ("fr", "p q"), ("fr", "p q r")]


def test_scores_above_64_bits(spark):
    """2000000 * a passes 64 bits: the score is that of exact numbers."""
    big = 2**60 + 7
    counts = spark.createDataFrame(
        [("en", "a", 2**61 + 1), ("en", "b", 2**61 + 3), ("en", "a b", big)], "lang string, phrase string, f long"
    )
    sizes = spark.createDataFrame([("en", 2**62)], "lang string, n long")
    patched = pytest.MonkeyPatch()
    patched.setattr(phrases, "phrase_counts", lambda docs, min_count: (counts, sizes))
    got = found(phrases.mine(counts))
    patched.undo()
    assert got == [("en", 1, "a b", big, 2**61 + 1, 2**61 + 3, 2**62, 2_000_000 * big // (2**62 + 4))]


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")
def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("lang", "text").collect()]
    wanted = brute(rows)
    assert wanted and found(queries.QUERIES["op11_phrases"](spark, SF_DIR)) == wanted
