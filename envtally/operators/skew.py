"""Joins whose large side may have a third of its rows under one key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_MOST_HOT_KEYS = 1000


def hot_keys(counts: DataFrame, keys: Sequence[str], count: str) -> DataFrame:
    """Keys with more than a thousandth of all that is counted, so less than a thousand keys."""
    total = counts.agg(F.coalesce(F.sum(count), F.lit(0)).alias("n")).scalar()
    return counts.where(F.col(count) * _MOST_HOT_KEYS > total).select(*keys)


def salted_join(
    large: DataFrame,
    small: DataFrame,
    keys: Sequence[str],
    spread: str,
    hot: DataFrame,
    how: str = "inner",
) -> DataFrame:
    """``large`` joined with ``small``, the hot keys of ``large`` spread over tasks by ``spread``.

    ``hot`` is the result of ``hot_keys``, whose size is bounded and which is therefore
    broadcast. Rows of ``small`` with a hot key are repeated once per shuffle partition, so
    the spread grows with the cluster; rows with other keys are not repeated.
    """
    parts = int(large.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    marked = F.broadcast(hot.withColumn("_hot", F.lit(True)))
    large, small = (side.join(marked, list(keys), "left") for side in (large, small))
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(spread), F.lit(parts)).cast("int")).otherwise(0)
    salts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0)))
    large = large.withColumn("_salt", salt).drop("_hot")
    small = small.withColumn("_salt", F.explode(salts)).drop("_hot")
    return large.join(small, [*keys, "_salt"], how).drop("_salt")
