"""Path expressions. Paths use forward slashes."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: directories that are never scanned.
DEFAULT_IGNORE = (".git", "node_modules", "vendor")


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """From the last dot of the base name, dot included; '' if there is none."""
    return F.regexp_extract(path, r"(\.[^./]*)\z", 1)


def is_dockerfile(path: Column) -> Column:
    named = base_name(path).startswith("Dockerfile")
    return named | path.endswith(".dockerfile")


def walk_key(path: Column) -> Column:
    """A string that sorts as a directory walk does: component by component.

    NUL cannot occur in a file name and is below every other byte, so ``a/b.js``
    sorts before ``a.js`` as it does when names are compared directory by directory.
    """
    return F.replace(path, F.lit("/"), F.lit("\x00"))


def path_of_walk_key(key: Column) -> Column:
    return F.replace(key, F.lit("\x00"), F.lit("/"))


def to_slash(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def parse_ignore(ignore: str | Iterable[str]) -> list[str]:
    """Directory names from a comma list or a sequence, trimmed; no directory has an empty name."""
    names = ignore.split(",") if isinstance(ignore, str) else ignore
    return [name.strip() for name in names if name.strip()]


def has_ignored_directory(path: Column, ignore: Iterable[str], root: Column | None = None) -> Column:
    """True where a directory of ``path``, from the scan root down, has an ignored name.

    Without ``root`` every directory of the path counts.
    """
    parts = F.split(path, "/")
    first = F.lit(1) if root is None else F.greatest(F.size(F.split(root, "/")), F.lit(1))
    directories = F.slice(parts, first, F.greatest(F.size(parts) - first, F.lit(0)))
    names = sorted({*DEFAULT_IGNORE, *parse_ignore(ignore)})
    return F.arrays_overlap(directories, F.array(*[F.lit(n) for n in names]))
