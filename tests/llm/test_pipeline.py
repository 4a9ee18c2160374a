from __future__ import annotations

import hashlib
import os
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from samples import DOCS, edge_docs, edge_rows, prose
from test_mixing import brute_targets, size
from test_simhash import brute

import corpus_pipeline
from envtally.llm import co_training as C
from envtally.llm import pretokens
from envtally.llm.oracle_sql import QUALITY_RULES
from envtally.llm.storage import checkpoint_folder

SF_DIR = "/root/testdata/sf0.001"
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def rows_of(df):
    return [tuple(r) for r in df.select(*COLUMNS).collect()]


def kept_by_rules(rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", rows)
    verdict = Counter((r[0], r[1]) for r in con.sql(f"SELECT doc_id, n_words FROM ({QUALITY_RULES}) WHERE kept").fetchall())
    out = Counter()
    for r in rows:
        key = (r[0], size(r[1]))
        if verdict[key]:
            verdict[key] -= 1
            out[r] += 1
    return out


def kept_by_classifier(spark, docs, labels):
    model = C.learn(docs, labels)
    rows = docs.select(*COLUMNS)
    if isinstance(model, float):
        return Counter(rows_of(rows) if model >= 0.5 else [])
    (content, metadata), combined = model
    features = C._features(rows, "f").select(*COLUMNS, "f.*").collect()
    x = C._matrices(features)
    logits = combined.logit(np.column_stack([content.logit(x[0]), metadata.logit(x[1])]))
    return Counter(tuple(r[c] for c in COLUMNS) for r, z in zip(features, logits) if z >= 0)


@pytest.mark.parametrize("data", ["given", "edge cases"])
def test_each_stage_equals_brute_force(spark, data):
    if data == "given" and not os.path.isdir(SF_DIR):
        pytest.skip("no test data")
    folder = f"{checkpoint_folder(spark)}/pipeline-test-{data[0]}"
    if data == "given":
        sf_dir, docs = SF_DIR, spark.read.parquet(f"{SF_DIR}/documents.parquet")
    else:
        sf_dir, docs = f"{folder}/tables", edge_docs(spark)
        labels = [(r[0], n % 2, 0) for n, r in enumerate(edge_rows()) if r[0] is not None and r[0] > 40]
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf_dir}/labels.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "quality_classifier", "simhash_near_dedup", "mixing", "byte_bpe"]
    seen = [docs]
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, seen[-1], sf_dir).write.parquet(f"{folder}/{number}")
        seen.append(spark.read.parquet(f"{folder}/{number}"))
        if number < 4:
            assert seen[-1].columns == docs.columns
    inputs = [rows_of(df) for df in seen[:5]]
    assert Counter(inputs[1]) == kept_by_rules(inputs[0])
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    assert Counter(inputs[2]) == kept_by_classifier(spark, seen[1], labels)
    _, fps, component = brute(inputs[2])
    groups = defaultdict(list)
    for r, fp in zip(inputs[2], fps):
        groups[component[fp]].append((r[0] is None, r[0] or 0))
    assert sorted((r[0] is None, r[0] or 0) for r in inputs[3]) == sorted(map(min, groups.values()))
    sizes = defaultdict(int)
    for r in inputs[3]:
        sizes[r[3]] += size(r[1])
    taken, times = defaultdict(int), Counter(inputs[4])
    for r, n in times.items():
        taken[r[3]] += n * size(r[1])
        assert n <= 2 and r in inputs[3]
    for source, target in brute_targets(sizes).items():
        assert abs(taken[source] - target) <= max(size(r[1]) for r in inputs[3] if r[3] == source)
    library = tiktoken.Encoding(
        "own", pat_str=P.PATTERN, mergeable_ranks=pretokens.read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={}
    )
    expected = Counter()
    for r in inputs[4]:
        ids = np.array(library.encode_ordinary(r[1] or ""), "<u4").tobytes()
        expected[r[0], ids, len(ids) // 4, hashlib.sha256((r[1] or "").encode()).hexdigest()] += 1
    got = Counter((r.doc_id, bytes(r.ids), r.n_tokens, r.decoded_sha256) for r in seen[5].collect())
    assert got == expected


def test_run_is_the_stages_in_order(spark, monkeypatch):
    calls = []
    stage = lambda name: lambda spark, docs, sf_dir: calls.append(name) or docs.where("doc_id % 2 = 0")
    monkeypatch.setattr(corpus_pipeline, "STAGES", [("a", stage("a")), ("b", stage("b"))])
    folder = f"{checkpoint_folder(spark)}/run-test"
    edge_docs(spark).write.parquet(f"{folder}/documents.parquet")
    got = corpus_pipeline.run(spark, folder)
    assert calls == ["a", "b"] and got.count() == sum(1 for r in edge_rows() if r[0] is not None and r[0] % 2 == 0)


def test_the_classifier_learns_from_documents_that_the_rules_took_out(spark):
    """All labelled bad documents fail the rules; an unlabelled one of their kind passes them."""
    rng = random.Random(8)
    clean = [(n, prose(rng, 150), "en", rng.choice("ab"), 900) for n in range(200)]
    bad = [(n, prose(rng, 20).upper() + "!! " * 8, "en", "bad", 120) for n in range(200, 260)]
    passes = (300, " ".join(w + "!" if n % 9 == 0 else w for n, w in enumerate(prose(rng, 150).split())), "en", "bad", 120)
    folder = f"{checkpoint_folder(spark)}/classifier-test"
    docs = spark.createDataFrame(clean + bad + [passes], DOCS)
    docs.write.parquet(f"{folder}/documents.parquet")
    labels = [(r[0], 1, 0) for r in clean[:100]] + [(r[0], 0, 0) for r in bad]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    after_rules = corpus_pipeline.rules(spark, docs, folder)
    assert {r.doc_id for r in after_rules.collect()} == {r[0] for r in clean} | {300}
    kept = {r.doc_id for r in corpus_pipeline.classifier(spark, after_rules, folder).collect()}
    assert kept == {r[0] for r in clean}


def test_few_labels_mostly_bad_keep_every_document(spark):
    docs = spark.createDataFrame([(n, "the of and " * 20, "en", "a", 220) for n in range(20)], DOCS)
    labels = spark.createDataFrame([(0, 1, 0)] + [(n, 0, 0) for n in range(1, 9)], "doc_id long, quality int, toxic int")
    assert C.keep(docs, labels).count() == 20
