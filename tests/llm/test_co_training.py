from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from samples import DOCS, edge_docs, edge_rows, empty_docs, prose, with_clashing_columns

from envtally.llm import co_training as C

LABELS = "doc_id long, quality int, toxic int"


def corpus(seed=5, n=400):
    """Every fourth document is junk; half of the junk comes from one source."""
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        words = prose(rng, rng.randint(5, 150)).split()
        text = rng.choice([" ".join(w + "###" for w in words), " ".join(words).upper() + "!! " * len(words), "spam " * 90]) if bad else " ".join(words)
        rows.append((i, text, "en", "bad" if bad and i % 8 == 0 else rng.choice("abc"), len(text)))
        if i % 5 < 3:
            labels.append((i, 0 if bad else 1, 0))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = corpus()
    known = [r for r in labels if r[0] % 3]
    docs = spark.createDataFrame(rows, DOCS)
    got = {r.doc_id: r for r in C.classify(docs, spark.createDataFrame(known, LABELS)).collect()}
    told = {r[0] for r in known}
    unseen = [i for i in range(len(rows)) if i not in told]
    assert sum(got[i].kept == (i % 4 != 0) for i in unseen) / len(unseen) >= 0.97
    kept = C.keep(with_clashing_columns(docs), spark.createDataFrame(known, LABELS))
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.kept}
    assert kept.columns == with_clashing_columns(docs).columns


def test_scores_equal_the_model_in_plain_numbers(spark):
    rows, labels = corpus(6, 200)
    docs, known = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS)
    (content, metadata), combined = C.learn(docs, known)
    features = C._features(docs, "f").select("doc_id", "f.*").collect()
    x = C._matrices(features)
    logits = np.column_stack([content.logit(x[0]), metadata.logit(x[1])])
    expected = dict(zip((r.doc_id for r in features), C._sigmoid(combined.logit(logits))))
    for r in C.classify(docs, known).collect():
        assert r.score == pytest.approx(expected[r.doc_id], abs=1e-9)


def test_views_teach_each_other():
    """Labels tell the first view little; the second is sure of the pool and passes it on."""
    rng = np.random.default_rng(0)
    y = np.tile([0.0, 1.0], 30)
    pool_y = np.tile([0.0, 1.0], 400)
    noisy = lambda truth, noise: (truth[:, None] * 2 - 1) + rng.normal(0, noise, (len(truth), 3))
    views, pool = [noisy(y, 2.0), noisy(y, 0.3)], [noisy(pool_y, 2.0), noisy(pool_y, 0.3)]
    alone = C.calibrated(views[0], y, None)[0]
    (taught, _), _ = C.co_train(views, y, pool)
    right = lambda m: ((m.logit(pool[0]) > 0) == (pool_y > 0)).mean()
    assert right(taught) >= right(alone)


def test_edge_cases(spark):
    rows = edge_rows()
    labels = [(r[0], n % 2, 0) for n, r in enumerate(rows)] + [(None, 1, 0), (20, None, None), (999, 1, 1), (30, 0, 0), (30, 1, 0)]
    got = C.classify(with_clashing_columns(edge_docs(spark)), spark.createDataFrame(labels, LABELS)).collect()
    assert sorted([str(r.doc_id) for r in got]) == sorted(str(r[0]) for r in rows)
    assert all(0 <= r.score <= 1 and r.kept == (r.score >= 0.5) for r in got)
    none = spark.createDataFrame([], LABELS)
    assert C.classify(empty_docs(spark), none).collect() == []
    assert all(r.kept for r in C.classify(edge_docs(spark), none).collect())
    one_class = spark.createDataFrame([(20, 1, 0), (21, 1, 0)], LABELS)
    assert all(r.kept for r in C.classify(edge_docs(spark), one_class).collect())


def test_the_sample_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(C, "MOST_LABELLED", 60)
    monkeypatch.setattr(C, "MOST_POOL", 30)
    seen = []
    original = C.co_train
    monkeypatch.setattr(C, "co_train", lambda views, y, pool: seen.append((len(y), len(pool[0]))) or original(views, y, pool))
    rows, labels = corpus()
    C.learn(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS))
    assert seen[0][0] == 60 and seen[0][1] <= 30


def test_a_plan_without_python(spark):
    rows, labels = corpus(1, 100)
    scored = C.scored(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS))
    assert "Python" not in scored.select(F.col("quality.score"))._jdf.queryExecution().executedPlan().toString()
