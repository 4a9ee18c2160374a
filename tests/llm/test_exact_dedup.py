from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from samples import edge_docs, edge_rows, empty_docs, with_clashing_columns

from envtally.llm import exact_dedup


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def brute(rows):
    """doc_id, keep_id, group_size, text_sha256 of each row, and how many rows stay."""
    groups = defaultdict(list)
    for r in rows:
        groups[normal(r[1])].append(r[0])
    out = []
    for r in rows:
        ids = groups[normal(r[1])]
        out.append((r[0], min((i for i in ids if i is not None), default=None), len(ids), hashlib.sha256(normal(r[1]).encode()).hexdigest()))
    return out, len(groups)


def check(df, rows):
    got = df.select("document.doc_id", "keep_id", "group_size", "text_sha256", "kept").collect()
    wanted, groups = brute(rows)
    assert Counter(tuple(r)[:4] for r in got) == Counter(wanted)
    kept = [r for r in got if r.kept]
    assert len(kept) == groups == len({r.text_sha256 for r in kept})
    assert all(r.doc_id == r.keep_id for r in kept)


def test_edge_rows_equal_brute_force(spark):
    check(exact_dedup.exact_duplicates(with_clashing_columns(edge_docs(spark))), edge_rows())
    assert exact_dedup.exact_duplicates(empty_docs(spark)).collect() == []


@pytest.mark.parametrize("fan_in, rounds", [(2, 5), (16, 3)])
def test_any_tree_over_many_partitions(spark, monkeypatch, fan_in, rounds):
    """A third of the rows is one text, more partitions than leaves, ids in any order."""
    monkeypatch.setattr(exact_dedup, "FAN_IN", fan_in)
    monkeypatch.setattr(exact_dedup, "ROUNDS", rounds)
    rows = [((n * 7919) % 1201, "hot  text" if n % 3 == 0 else f"text {n % 211}\n{n % 5}", "en", "a", n) for n in range(1201)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(37, "n_chars")
    check(exact_dedup.exact_duplicates(docs), rows)


def test_a_hot_text_is_few_entries_at_every_level(spark):
    """Rows of one text that meet at a node are bounded by its children, not by the copies."""
    docs = spark.range(0, 20_000, 1, 32).select(F.col("id").alias("doc_id"), F.lit("same").alias("text"))
    runs = exact_dedup._runs(docs, ["doc_id"])
    spread = runs.groupBy("_leaf").count().collect()
    assert len(spread) == 32 and max(r["count"] for r in spread) == 625
    root = exact_dedup._merged(runs).collect()
    assert len(root) == 1 and root[0]._size == 20_000 and len(root[0]._leaves) == 32


def test_a_digest_collision_is_not_a_copy(spark, monkeypatch):
    """Equal digests of the runs with different proofs stay apart."""
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda *c: F.lit(7).cast("long"))
    check(exact_dedup.exact_duplicates(edge_docs(spark)), edge_rows())


def test_deduplicate_keeps_columns_and_one_row_of_each(spark):
    docs = with_clashing_columns(edge_docs(spark))
    kept = exact_dedup.deduplicate(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert len(rows) == len({normal(r.text) for r in rows}) == brute(edge_rows())[1]


def test_no_python_in_the_plan(spark):
    plan = exact_dedup.exact_duplicates(edge_docs(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
