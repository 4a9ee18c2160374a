from __future__ import annotations

import json
from collections import Counter

import pytest
from helpers import rows
from pyspark.sql import functions as F

import brute
from envtally import scan
from envtally.operators.skew import hot_keys, salted_join
from envtally.plans import reports


@pytest.fixture
def sides(spark):
    n = F.col("id")
    key = F.when(n % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), (n % 2000).cast("string")))
    large = spark.range(6000).select(key.alias("k"), n.cast("string").alias("n"))
    small = spark.createDataFrame([("hot", 1), ("hot", 2), ("k1", 3), ("none", 4)], "k string, s int")
    return large, small


@pytest.mark.parametrize("how", ["inner", "left_semi"])
def test_salted_join_equals_a_join(sides, how):
    large, small = sides
    hot = hot_keys(large.groupBy("k").agg(F.count("*").alias("c")), ("k",), "c")
    got = salted_join(large, small, ("k",), "n", hot, how)
    assert rows(got) == rows(large.join(small, "k", how))


def test_hot_keys_are_those_with_more_than_a_thousandth(sides):
    counts = sides[0].groupBy("k").agg(F.count("*").alias("c"))
    assert rows(hot_keys(counts, ("k",), "c")) == [("hot",)]
    assert hot_keys(counts.limit(0), ("k",), "c").count() == 0


def test_a_hot_key_is_spread_over_as_many_tasks_as_there_are(spark, sides):
    large, small = sides
    hot = hot_keys(large.groupBy("k").agg(F.count("*").alias("c")), ("k",), "c")
    settings = {
        "spark.sql.shuffle.partitions": "128",
        "spark.sql.adaptive.enabled": "false",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
    }
    before = {name: spark.conf.get(name) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        joined = salted_join(large, small, ("k",), "n", hot).withColumn("task", F.spark_partition_id())
        sizes = Counter(r[0] for r in joined.where("k = 'hot'").select("task").collect())
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert len(sizes) > 32 and max(sizes.values()) < 4000 / 10
    plan = joined._jdf.queryExecution().toString()
    assert "CASE WHEN _hot" in plan  # other keys have one salt, so they are not repeated


def test_a_hot_project_with_a_hot_variable(spark):
    """A third of all files in one project, all of them with the same variable."""
    n = F.col("id")
    hot = n % 3 == 0
    files = spark.range(1500).select(
        F.when(hot, F.lit("hot")).otherwise(F.concat(F.lit("p"), (n % 40).cast("string"))).alias("project"),
        F.concat(F.lit("d"), (n % 7).cast("string"), F.lit("/f"), n.cast("string"), F.lit(".js")).alias("path"),
        F.when(hot, F.concat(F.lit("process.env.HOT\n\nprocess.env.HOT process.env.H"), n.cast("string")))
        .otherwise(F.lit("process.env.X process.env.Y"))
        .alias("content"),
    )
    env = files.select(
        "project", F.lit(0).alias("ordinal"), F.lit(".env").alias("env_path"), F.lit("Y=1").alias("content")
    ).distinct()
    texts = [(r.path, r.content) for r in files.where("project = 'hot'").collect()]
    expected = brute.audit(texts, [(".env", "Y=1")])
    result = scan(files, env).pinned()
    report = reports.json_report(result).where("project = 'hot'").orderBy("section", "item", "part")
    assert json.loads("".join(r.text for r in report.collect())) == brute.json_report(expected)
    found = result.findings.where("project = 'hot'")
    assert sorted(rows(found, "rule_id", "variable", "path", "line_no", "declared_source"), key=str) == expected["findings"]
