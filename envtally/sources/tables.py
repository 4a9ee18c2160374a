"""Filters and labels over the ``files`` and ``env_files`` tables.

``files``: project STRING, path STRING, content STRING (NULL = unreadable); optional
``root STRING`` (the scan root ``path`` starts with), ``is_symlink BOOLEAN``, and
``unlistable BOOLEAN`` (not a file but a directory whose files are not known).
``env_files``: project STRING, ordinal INT, env_path STRING, content STRING (NULL =
unreadable).

All tests but those for over-long lines look at paths only.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from envtally.functions.names import DEFAULT_PATTERNS
from envtally.functions.paths import extension, has_ignored_directory, is_dockerfile, parse_ignore
from envtally.functions.reuse import built_once
from envtally.functions.text import MAX_LINE_BYTES, failure, is_oversize

DOCKER, SOURCE = "docker", "source"


def _is_candidate(files: DataFrame, extensions: Iterable[str]) -> Column:
    test = _has_candidate_name(tuple(extensions))
    for flag in ("is_symlink", "unlistable"):
        test = test & ~_flag(files, flag)
    return test


@built_once
def _has_candidate_name(extensions: tuple[str, ...]) -> Column:
    path = F.col("path")
    return extension(path).isin(*extensions) | is_dockerfile(path)


def _flag(files: DataFrame, name: str) -> Column:
    """An optional column; NULL is false."""
    return F.coalesce(F.col(name), F.lit(False)) if name in files.columns else F.lit(False)


def _is_ignored(files: DataFrame, ignore: str | Iterable[str]) -> Column:
    return _in_ignored_directory(tuple(parse_ignore(ignore)), "root" in files.columns)


@built_once
def _in_ignored_directory(names: tuple[str, ...], with_root: bool) -> Column:
    return has_ignored_directory(F.col("path"), names, F.col("root") if with_root else None)


def candidate_files(files: DataFrame, extensions: Iterable[str] = DEFAULT_PATTERNS) -> DataFrame:
    """Files with a known extension (case-sensitive) or a Dockerfile-like name.

    Of a snapshot only the partitions that hold such files are read.
    """
    wanted = _is_candidate(files, extensions)
    if {"kind", "lang"} <= set(files.columns):
        stored = (F.col("kind") == DOCKER) | ((F.col("kind") == SOURCE) & F.col("lang").isin(*extensions))
        return files.where(stored).where(wanted).drop("kind", "lang")
    return files.where(wanted)


def write_snapshot(
    files: DataFrame,
    path: str,
    ignore: str | Iterable[str] = (),
    extensions: Iterable[str] = DEFAULT_PATTERNS,
    mode: str = "error",
) -> None:
    """Store ``files`` as Parquet, partitioned by what a scan with these options makes of them.

    ``kind`` is 'docker', 'source' or 'other', ``lang`` the extension of candidates. Ignored
    files are 'other'; the texts of 'other' files, which no scan opens, are not stored. What
    is read back can be given to ``scan`` with the same options, or with fewer extensions or
    more directories to ignore.
    """
    scanned = _is_candidate(files, extensions) & ~_is_ignored(files, ignore)
    labelled = classify_files(files, extensions)
    (
        labelled.withColumns(
            {
                "content": F.when(scanned, F.col("content")),
                "kind": F.when(scanned, F.col("kind")).otherwise("other"),
                "lang": F.when(scanned, F.col("lang")).otherwise(""),
            }
        )
        .drop("multiplicity")
        .write.mode(mode)
        .partitionBy("kind", "lang")
        .parquet(path)
    )


def prune_ignored(files: DataFrame, ignore: str | Iterable[str] = ()) -> DataFrame:
    """Files with no directory component named in the ignore list."""
    return files.where(~_is_ignored(files, ignore))


def counted_files(
    files: DataFrame,
    ignore: str | Iterable[str] = (),
    extensions: Iterable[str] = DEFAULT_PATTERNS,
) -> DataFrame:
    """``project, path, multiplicity, unlistable`` of every file: how often a scan counts it."""
    scanned = _is_candidate(files, extensions) & ~_is_ignored(files, ignore)
    return classify_files(files.drop("kind", "lang"), extensions).select(
        "project",
        "path",
        F.when(scanned, F.col("multiplicity")).otherwise(0).alias("multiplicity"),
        _flag(files, "unlistable").alias("unlistable"),
    )


def classify_files(files: DataFrame, extensions: Iterable[str] = DEFAULT_PATTERNS) -> DataFrame:
    """Add ``kind`` ('docker', 'source' or NULL), ``lang`` (the extension) and ``multiplicity``.

    A file that is a candidate by extension and by name, such as ``Dockerfile.py``,
    is a Dockerfile that is counted twice.
    """
    return files.withColumns(_labels(tuple(extensions)))


@built_once
def _labels(extensions: tuple[str, ...]) -> dict[str, Column]:
    path = F.col("path")
    docker, source = is_dockerfile(path), extension(path).isin(*extensions)
    return {
        "kind": F.when(docker, F.lit(DOCKER)).when(source, F.lit(SOURCE)),
        "lang": extension(path),
        "multiplicity": docker.cast("int") + source.cast("int"),
    }


def oversize_files(files: DataFrame, max_line_bytes: int = MAX_LINE_BYTES) -> DataFrame:
    """Files with a line of ``max_line_bytes`` or more; audits that set this limit leave them out."""
    return files.where(is_oversize(F.col("content"), max_line_bytes)).select("project", "path")


def env_sources(env_files: DataFrame, max_line_bytes: int | None = None) -> DataFrame:
    """The env files that can be read."""
    return env_files.where(failure(F.col("content"), max_line_bytes).isNull()).select(
        "project", "ordinal", "env_path", "content"
    )


def project_counts(
    counted: DataFrame, env_files: DataFrame, max_line_bytes: int | None = None
) -> DataFrame:
    """Rows of ``project, files_scanned, unlistable, readable_env_files`` to be summed up:
    one for each of ``counted_files`` and each env file."""
    none = F.lit(0).cast("long")
    files = counted.select(
        "project",
        F.col("multiplicity").cast("long").alias("files_scanned"),
        F.col("unlistable").cast("long").alias("unlistable"),
        none.alias("readable_env_files"),
    )
    readable = failure(F.col("content"), max_line_bytes).isNull()
    return files.unionByName(
        env_files.select(
            "project",
            none.alias("files_scanned"),
            none.alias("unlistable"),
            readable.cast("long").alias("readable_env_files"),
        )
    )


def readable_projects(env_files: DataFrame, max_line_bytes: int | None = None) -> DataFrame:
    """Projects that can be audited at all: at least one env file can be read."""
    return env_sources(env_files, max_line_bytes).select("project").distinct()
