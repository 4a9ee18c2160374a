"""Loaders for source trees and env files on a file system that every executor mounts.

Spark's own text and binary sources skip names that start with a dot or an underscore and
follow symbolic links, so trees are listed here: level by level, each level a Spark job
over the directories the level before found. The driver sees neither names nor texts, and
a directory that cannot be listed fails its project and not the job.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator, Mapping, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from envtally.functions.names import DEFAULT_PATTERNS
from envtally.functions.paths import DEFAULT_IGNORE, extension, is_dockerfile, parse_ignore
from envtally.operators.pinning import pin

_LISTING = "project string, root string, path binary, is_dir boolean, size bigint, unlistable boolean"
_COLUMNS = ["project", "root", "path", "is_dir", "size", "unlistable"]
_BATCH_ROWS = 1024
_BATCH_BYTES = 16 << 20
_TASK_BYTES = 64 << 20


def _entries(directory: bytes, ignored: set[bytes]) -> Iterator[tuple]:
    """Path, whether it is a directory, and size of what is in a directory; no links."""
    with os.scandir(directory) as entries:
        for entry in entries:
            is_dir = entry.is_dir(follow_symlinks=False)
            if is_dir and entry.name in ignored:
                continue
            if not is_dir and not entry.is_file(follow_symlinks=False):
                continue
            path = os.path.join(directory, entry.name)
            yield path, is_dir, 0 if is_dir else entry.stat(follow_symlinks=False).st_size


def _listing(ignore: Sequence[str], roots: bool):
    """A task that lists directories; those that it cannot list come out as ``unlistable``.

    Of ``roots``, one that is a link or has an ignored name has no entries. A link that is
    written with a slash at the end is followed.
    """
    ignored = {os.fsencode(name) for name in ignore}

    def list_directories(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[tuple] = []
        for batch in batches:
            for project, root, directory in zip(batch["project"], batch["root"], batch["path"]):
                directory = given = bytes(directory)
                if roots:
                    directory = os.path.normpath(directory)
                    root = os.fsdecode(directory)
                    is_link = os.path.islink(directory) and not given.endswith(b"/")
                    if is_link or os.path.basename(directory) in ignored:
                        continue
                try:
                    if not os.path.isabs(directory):
                        raise OSError("a relative path means nothing on another machine")
                    found = [(project, root, *entry, False) for entry in _entries(directory, ignored)]
                except OSError:
                    found = [(project, root, directory, False, 0, True)]
                rows += found
                while len(rows) >= _BATCH_ROWS:
                    yield pd.DataFrame(rows[:_BATCH_ROWS], columns=_COLUMNS)
                    rows = rows[_BATCH_ROWS:]
        if rows:
            yield pd.DataFrame(rows, columns=_COLUMNS)

    return list_directories


def _read(path: bytes, max_bytes: int | None) -> bytes | None:
    """The bytes of a file; None where it cannot be read, is too large or its path is relative.

    A relative path would mean another file on each machine.
    """
    if not os.path.isabs(path):
        return None
    try:
        with open(path, "rb") as file:
            if max_bytes is None:
                return file.read()
            # One more than allowed tells without a look at a size that may have changed.
            content = file.read(max_bytes + 1)
    except OSError:
        return None
    return content if len(content) <= max_bytes else None


def _reading(columns: Sequence[str], max_bytes: int | None):
    """A task that adds what ``_read`` has of each ``path``."""

    def read_files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[tuple] = []
        held = 0
        for batch in batches:
            for row in batch[list(columns)].itertuples(index=False):
                content = _read(bytes(row.path), max_bytes)
                rows.append((*row, content))
                held += len(content or b"")
                if held >= _BATCH_BYTES:
                    yield pd.DataFrame(rows, columns=[*columns, "content"])
                    rows, held = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=[*columns, "content"])

    return read_files


def load_tree(
    spark: SparkSession,
    roots: Mapping[str, str] | DataFrame,
    ignore: str | Iterable[str] = (),
    extensions: Iterable[str] = DEFAULT_PATTERNS,
    max_file_bytes: int | None = None,
) -> DataFrame:
    """The candidate files below the root of each project, as a ``files`` table.

    ``roots`` is a mapping, or a table of project and root. Roots are absolute. ``path`` is
    the root joined with the relative path. A root that is a symbolic link, or whose own name
    is ignored, has no files. A directory that cannot be listed, a missing root for one, is a
    row that is ``unlistable``: its project cannot be audited, the others can. Files are dealt
    out to tasks by number, about 64 MiB each, whatever directory they are in. A file of more
    than ``max_file_bytes`` is one that cannot be read: no text, and a warning of a scan; by
    default files are of any size.
    """
    names = [*DEFAULT_IGNORE, *parse_ignore(ignore)]
    if isinstance(roots, DataFrame):
        start = roots.select("project", "root")
    else:
        relative = [root for root in roots.values() if not os.path.isabs(root)]
        if relative:
            raise ValueError(f"roots must be absolute paths: {relative[:5]}")
        start = spark.createDataFrame(list(roots.items()), "project string, root string")
    level = start.withColumn("path", F.col("root").cast("binary"))
    # A number, or adaptive execution would put so few bytes of names into one task.
    listers = max(
        spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))
    )
    path = F.col("path").cast("string")
    wanted = extension(path).isin(*extensions) | is_dockerfile(path)

    listed = []
    while True:
        entries = pin(
            level.repartition(listers, "path")
            .mapInPandas(_listing(names, roots=not listed), _LISTING)
            .where(F.col("is_dir") | F.col("unlistable") | wanted)
        )
        listed.append(entries.where(~F.col("is_dir")).drop("is_dir"))
        level = entries.where("is_dir").select("project", "root", "path")
        if level.isEmpty():
            break
    files = reduce(DataFrame.unionByName, listed)

    total = files.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).first()["bytes"]
    tasks = max(spark.sparkContext.defaultParallelism, -(-total // _TASK_BYTES))
    columns = ["project", "root", "path", "unlistable"]
    return (
        files.select(*columns)
        .repartition(tasks, "path")
        .mapInPandas(
            _reading(columns, max_file_bytes),
            "project string, root string, path binary, unlistable boolean, content binary",
        )
        .select(
            "project",
            "root",
            path.alias("path"),
            # A cast and not a decode: malformed UTF-8 is kept as it is.
            F.col("content").cast("string").alias("content"),
            "unlistable",
        )
    )


def load_env_files(
    spark: SparkSession,
    env_files: Mapping[str, Sequence[str]] | DataFrame,
    max_file_bytes: int | None = None,
) -> DataFrame:
    """The env files of each project, in order, as an ``env_files`` table.

    ``env_files`` is a mapping, or a table of project, ordinal and env_path. Paths are
    absolute: a relative one in a mapping is an error, in a table an env file that cannot be
    read, as is one of more than ``max_file_bytes``.
    """
    if isinstance(env_files, DataFrame):
        table = env_files.select("project", "ordinal", F.col("env_path").cast("binary").alias("path"))
    else:
        relative = [path for paths in env_files.values() for path in paths if not os.path.isabs(path)]
        if relative:
            raise ValueError(f"env files must have absolute paths: {relative[:5]}")
        listed = [
            (project, ordinal, os.fsencode(path))
            for project, paths in env_files.items()
            for ordinal, path in enumerate(paths)
        ]
        table = spark.createDataFrame(listed, "project string, ordinal int, path binary")
    columns = ["project", "ordinal", "path"]
    return (
        table.repartition(spark.sparkContext.defaultParallelism, "path")
        .mapInPandas(_reading(columns, max_file_bytes), "project string, ordinal int, path binary, content binary")
        .select(
            "project",
            "ordinal",
            F.col("path").cast("string").alias("env_path"),
            F.col("content").cast("string").alias("content"),
        )
    )
