"""Results that are computed once: checkpoints in the shared folder, and columns."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session.

    ``spark.checkpoint.dir`` names it. Where that is unset, as in tests, it is a folder
    below the session's warehouse.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        warehouse = spark.conf.get("spark.sql.warehouse.dir")
        context.setCheckpointDir(folder or f"{warehouse}/checkpoints-{uuid.uuid4()}")
    return context.getCheckpointDir()


def written(df: DataFrame) -> DataFrame:
    """``df`` as a checkpoint in the shared folder, its lineage cut.

    What was written outlives the executors that wrote it.
    """
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def computed_once(df: DataFrame, name: str, value: Column, columns: list[str]) -> DataFrame:
    """``columns`` of ``df``, and ``value`` as the column ``name``.

    A filter on a column of a projection would be moved below it, and compute anew, for each
    mention, all that the column is made of. It is not moved below an explode.
    """
    work = f"_{name}_value"
    return df.withColumn(work, value).select(*columns, F.explode(F.array(work)).alias(name))
