"""JSON text of single values, for reports that are emitted piece by piece."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def json_string(col: Column) -> Column:
    """A string as a quoted JSON string."""
    return F.regexp_replace(F.to_json(F.array(col)), r"\A\[|\]\z", "")


def json_location(path: Column, line_no: Column) -> Column:
    return F.to_json(F.struct(path.alias("FilePath"), line_no.alias("LineNumber")))
