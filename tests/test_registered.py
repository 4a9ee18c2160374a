from __future__ import annotations

import os

import pytest
from check_oracle import connect, difference
from pyspark.sql import functions as F

import __spark_entry__ as entry
from envtally.operators import extract as X

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", list(entry.own_queries()))
def test_query_equals_its_sql(spark, con, name):
    assert difference(entry.queries()[name](spark, SF_DIR), con, entry.oracle_sql()[name]) == ""


def test_every_query_has_sql():
    assert set(entry.own_queries()) <= set(entry.oracle_sql())


def test_known_counts(spark):
    result = entry._scan(spark, SF_DIR, max_line_bytes=65536).pinned()
    assert result.files.where("multiplicity > 0").agg(F.count("*"), F.sum("multiplicity")).first()[:] == (140, 160)
    roles = dict(tuple(r) for r in result.facts.groupBy("role").count().collect())
    assert (roles[X.CODE_USED], roles[X.DOCKER_USED]) == (256, 149)
    assert dict(tuple(r) for r in result.findings.groupBy("rule_id").count().collect()) == {
        "ENV001": 64, "ENV002": 155, "ENV003": 145, "ENV004": 177, "ENV005": 47
    }
    assert result.gate.where("status != 2").count() == 19


def test_entry(spark):
    assert entry.entry(spark).columns == [
        "project", "rule_id", "level", "variable", "message", "path", "line_no", "declared_source"
    ]
