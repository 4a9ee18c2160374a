from __future__ import annotations

import os
import random
import zlib
from collections import Counter

import pytest
from samples import DOCS, edge_docs, edge_rows, empty_docs, with_clashing_columns

from envtally.llm import language_id

SF = "/root/testdata/sf0.001"


def grams(text):
    """n-gram -> count, on strings: letters in lower case, all else one space."""
    letters = "".join(c.lower()[0] if c.isalpha() else " " for c in text)
    padded = " " + " ".join(letters.split()) + " "
    if len(padded) < 3:
        return Counter()
    found = Counter(c for c in padded if c != " ")
    found.update(padded[i : i + 2] for i in range(len(padded) - 1))
    found.update(padded[i : i + 3] for i in range(len(padded) - 2) if padded[i + 1] != " ")
    return found


def number(gram):
    out = 0
    for c in gram:
        out = out << 21 | ord(c)
    return out


def top(counts):
    return sorted(counts, key=lambda g: (-counts[g], number(g)))[: language_id.PROFILE]


def brute(rows):
    """Predictions with profiles of all documents that are not held out."""
    out_of_reach = lambda i: zlib.crc32(str(i).encode()) % 4 == 2 if i is not None else False
    counts = {}
    for r in rows:
        if r[1] is not None and r[2] is not None and not out_of_reach(r[0]):
            counts.setdefault(r[2], Counter()).update(grams(r[1]))
    profiles = {name: {g: n for n, g in enumerate(top(c))} for name, c in counts.items() if c}
    result = []
    for r in rows:
        own = top(grams(r[1] or ""))
        best, name = 0.0, "und"
        if own and profiles:
            far = language_id.PROFILE
            distance = lambda p: sum(abs(p[g] - n) if g in p else far for n, g in enumerate(own))
            name = min(sorted(profiles), key=lambda x: distance(profiles[x]))
            best = 1 - distance(profiles[name]) / (far * len(own))
        result.append((r[0], out_of_reach(r[0]), name, round(best, 9)))
    return sorted(result, key=str)


def rounded(rows):
    return sorted([(r.doc_id, r.held_out, r.lang_pred, round(r.score, 9)) for r in rows], key=str)


def test_predictions_equal_brute_force(spark):
    docs = edge_docs(spark)
    assert rounded(language_id.language_id(docs).collect()) == brute(edge_rows())
    extra = with_clashing_columns(docs)
    assert rounded(language_id.language_id(extra).collect()) == brute(edge_rows())
    assert language_id.language_id(empty_docs(spark)).collect() == []


def test_no_letters_are_undetermined(spark):
    rows = [(n, t, "en", "a", 0) for n, t in enumerate([None, "", "123 !? 😀", "²", "ab"])]
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.language_id(spark.createDataFrame(rows, DOCS)).collect()}
    assert [got[n] for n in range(4)] == [("und", 0.0)] * 4 and got[4][0] in ("en", "und")


def test_nothing_to_learn_from(spark):
    got = language_id.language_id(spark.createDataFrame([(1, "some words", None, "a", 0)], DOCS)).collect()
    assert [(r.lang_pred, r.score) for r in got] == [("und", 0.0)]


def test_profiles_of_a_sample_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(language_id, "SAMPLE", 10)
    rng = random.Random(1)
    rows = [(n, "abc " * 5, rng.choice(["en", "en", "fr", "de"]), "a", 0) for n in range(400)]
    learned = language_id.learn(spark.createDataFrame(rows, DOCS))
    assert [list(block) for block in learned] == [["de", "en", "fr"]]


def test_blocks_of_languages_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(language_id, "BLOCK", 2)
    monkeypatch.setattr(language_id, "MOST_BROADCAST", 0)
    rng = random.Random(3)
    letters = "abcdefghij"
    rows = [(n, "".join(rng.choice(letters[n % 5 : n % 5 + 5] + " ") for _ in range(80)), f"l{n % 7}", "a", 0) for n in range(150)]
    docs = spark.createDataFrame(rows, DOCS)
    assert [len(block) for block in language_id.learn(docs)] == [2, 2, 2, 1]
    assert rounded(language_id.language_id(docs).collect()) == brute(rows)


def test_any_number_of_languages(spark):
    word = lambda n: chr(0x4E00 + n) + chr(0x6E00 + n)
    rows = [(n, f"{word(n % 1500)} " * 3, f"l{n % 1500}", "a", 0) for n in range(12_000)]
    got = language_id.language_id(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == len(rows) and all(r.lang_pred == f"l{r.doc_id % 1500}" for r in got)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = language_id.language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL")
    n, right = got.selectExpr("count(*)", "count_if(lang = lang_pred)").first()
    assert n > 20 and right / n >= 0.97
