"""Line-level operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from envtally.functions.text import (
    drop_cr,
    is_significant,
    join_continued,
    line_pieces,
    trim_space,
)


def _numbered(files: DataFrame, text: Column) -> DataFrame:
    return files.select("project", "path", F.posexplode(line_pieces(text)).alias("pos", "text")).select(
        "project", "path", (F.col("pos") + 1).alias("line_no"), drop_cr(F.col("text")).alias("text")
    )


def split_lines(files: DataFrame) -> DataFrame:
    """Physical lines, numbered from 1."""
    return _numbered(files, F.col("content"))


def logical_lines(files: DataFrame) -> DataFrame:
    """Dockerfile lines with continuations joined, numbered after joining."""
    return _numbered(files, join_continued(F.col("content")))


def significant_lines(lines: DataFrame) -> DataFrame:
    """Trimmed lines without blank ones and comments."""
    trimmed = lines.withColumn("text", trim_space(F.col("text")))
    return trimmed.where(is_significant(F.col("text")))
