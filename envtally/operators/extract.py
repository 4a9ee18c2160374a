"""Facts: who declares and who uses a variable, and where.

``extract_facts`` reads every text once and turns it into narrow rows

    project, role, variable, path, line_no, ordinal

in one pass without a shuffle: a substring or FROM test drops texts without facts, the
rest is split into lines, and the regexes run on lines that pass the test again. The
text itself never leaves that pass. The single operators are selections of it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from envtally.functions.names import (
    DEFAULT_PATTERNS,
    GO_PATTERNS,
    JS_PATTERNS,
    NAME,
    PYTHON_PATTERNS,
    Patterns,
    matches,
    may_match,
)
from envtally.functions.reuse import built_once, frozen
from envtally.functions.text import (
    BLANK,
    BLANKS,
    NOT_SPACE,
    SPACE,
    SPACE_IN_LINE,
    WHITE_SPACE,
    failure,
    join_continued,
    trim_space,
)
from envtally.operators.lines import significant_lines
from envtally.sources.tables import DOCKER, SOURCE, classify_files

# Roles of a fact. The failures carry no variable; they are rows like the others so
# that warnings do not cost a second read of the texts.
ENV_DECLARED = "env_declared"
CODE_USED = "code_used"
DOCKER_DECLARED = "docker_declared"
DOCKER_USED = "docker_used"
FAILURES = ("unreadable", "oversize")

FACT_COLUMNS = ("project", "role", "variable", "path", "line_no", "ordinal")

# Fixed value: how a variable is used in a Dockerfile.
DOCKER_USE = r"\$\{?([A-Z][A-Z0-9_]*)\}?"


def _no_names() -> Column:
    return F.array().cast("array<string>")


def _first_group(text: Column, pattern: str) -> Column:
    return F.array(F.regexp_extract(text, pattern, 1))


def _has_from(logical: Column) -> Column:
    """A significant line starts with FROM, a blank and some image."""
    return logical.rlike(rf"(?dm)^{SPACE_IN_LINE}*(?i:FROM)[\t\f\r ][^\n]*{NOT_SPACE}")


def _env_instruction_names(text: Column) -> Column:
    """Names an ENV instruction declares: ``A=1 B=2``, or ``A some value``."""
    rest = F.regexp_extract(text, rf"(?i:\AENV){BLANK}+([^\n]+)", 1)
    pairs = F.regexp_extract_all(rest, F.lit(rf"(?:\A|{SPACE})({NAME})="))
    single = _first_group(rest, rf"\A{SPACE}*({NAME})(?:{SPACE}|\z)")
    return F.when(rest.contains("="), pairs).otherwise(single)


def _arg_instruction_names(text: Column) -> Column:
    """The one name an ARG instruction declares: ``A``, or ``A=default``."""
    return _first_group(text, rf"(?i:\AARG){BLANK}+{SPACE}*({NAME}){SPACE}*(?:=|\z)")


def _instruction(text: Column, *words: str) -> Column:
    """The line starts with one of these words, in any case, and a blank."""
    starts = [word + blank for word in words for blank in BLANKS]
    return F.upper(F.substring(text, 1, len(starts[0]))).isin(*starts)


def _docker_declared_names(text: Column) -> Column:
    return (
        F.when(_instruction(text, "ENV"), _env_instruction_names(text))
        .when(_instruction(text, "ARG"), _arg_instruction_names(text))
        .otherwise(_no_names())
    )


def _docker_used_names(text: Column) -> Column:
    """Names used on a line, each once."""
    names = F.array_distinct(F.regexp_extract_all(text, F.lit(DOCKER_USE)))
    return F.when(text.contains("$"), names).otherwise(_no_names())


def _may_have_docker_fact(text: Column) -> Column:
    """A test of the untrimmed line; trimming on the left is enough for it and cheaper."""
    left = F.ltrim(text, F.lit(WHITE_SPACE))
    named = text.contains("$") | _instruction(left, "ENV", "ARG")
    return named & ~left.startswith("#")


def _by_language(patterns: Patterns) -> list[tuple[list[str], tuple[str, ...]]]:
    """Extensions grouped by equal patterns, so that each group is tested once."""
    groups: dict[tuple[str, ...], list[str]] = {}
    for ext, regexes in patterns.items():
        groups.setdefault(tuple(regexes), []).append(ext)
    return [(exts, regexes) for regexes, exts in groups.items()]


def _names_in_code(lang: Column, text: Column, patterns: Patterns) -> Column:
    names = F.when(F.lit(False), _no_names())
    for exts, regexes in _by_language(patterns):
        names = names.when(lang.isin(*exts), matches(text, regexes))
    return names


def _may_have_code_use(lang: Column, text: Column, patterns: Patterns) -> Column:
    test = F.lit(False)
    for exts, regexes in _by_language(patterns):
        test = test | (lang.isin(*exts) & may_match(text, regexes))
    return test


def _fact_rows(lines: DataFrame, role_names: Column, ordinal: Column) -> DataFrame:
    return (
        lines.select(
            "project", "path", "line_no", ordinal.alias("ordinal"),
            F.explode(role_names).alias("found"),
        )
        .select("project", "path", "line_no", "ordinal", "found.role", F.explode("found.names").alias("variable"))
        .where(F.col("variable").isNull() | (F.col("variable") != ""))
        .select(*FACT_COLUMNS)
    )


def _found(role: str | Column, names: Column) -> Column:
    role = F.lit(role) if isinstance(role, str) else role
    return F.struct(role.alias("role"), names.alias("names"))


class _Expressions(NamedTuple):
    """What a scan of the files of some kinds computes, file by file and then line by line."""

    failed: Column
    relevant: Column
    lines: Column
    may_have_fact: Column
    text: Column
    found: Column


@built_once
def _expressions(kinds: tuple[str, ...], frozen_patterns: tuple, max_line_bytes: int | None) -> _Expressions:
    """Expressions over files and lines of the given kinds; they hold what those kinds need only."""
    patterns = dict(frozen_patterns)
    content, lang, text, failed = F.col("content"), F.col("lang"), F.col("text"), F.col("failed")

    def by_kind(docker: Callable[[], Column], source: Callable[[], Column]) -> Column:
        if kinds == (DOCKER,):
            return docker()
        if kinds == (SOURCE,):
            return source()
        return F.when(F.col("kind") == DOCKER, docker()).otherwise(source())

    nameless = F.array(_found(failed, F.array(F.lit(None).cast("string"))))
    found = by_kind(
        lambda: F.array(
            _found(DOCKER_DECLARED, _docker_declared_names(text)),
            _found(DOCKER_USED, _docker_used_names(text)),
        ),
        lambda: F.array(_found(CODE_USED, _names_in_code(lang, text, patterns))),
    )
    return _Expressions(
        failed=failure(content, max_line_bytes),
        relevant=by_kind(
            lambda: _has_from(join_continued(content)), lambda: _may_have_code_use(lang, content, patterns)
        ),
        lines=_pieces(failed, by_kind(lambda: join_continued(content), lambda: content)),
        may_have_fact=by_kind(
            lambda: _may_have_docker_fact(text), lambda: _may_have_code_use(lang, text, patterns)
        ),
        text=by_kind(lambda: trim_space(text), lambda: text),
        found=F.when(failed.isNotNull(), nameless).otherwise(found),
    )


def _pieces(failed: Column, content: Column) -> Column:
    """The lines of a text, numbered from 0; one that failed has a single empty one."""
    lines = F.when(failed.isNotNull(), F.array(F.lit(""))).otherwise(F.split(content, "\n"))
    return F.posexplode(lines).alias("pos", "text")


def _facts_of(files: DataFrame, kinds: tuple[str, ...], patterns: Patterns, max_line_bytes: int | None) -> DataFrame:
    """Facts of the files of the given kinds."""
    of = _expressions(kinds, frozen(patterns), max_line_bytes)
    of_kind = classify_files(files, patterns).where(F.col("kind").isin(*kinds))
    lines = (
        of_kind.where(of.failed.isNotNull() | of.relevant)
        # Before the explode, so that it is decided once per file and not per line.
        .withColumn("failed", of.failed)
        .select("project", "path", "kind", "lang", "failed", of.lines)
    )
    failed = F.col("failed")
    kept = lines.where(failed.isNotNull() | of.may_have_fact).withColumns(
        {"line_no": F.when(failed.isNull(), F.col("pos") + 1), "text": of.text}
    )
    return _fact_rows(kept, of.found, F.lit(None).cast("int"))


def extract_facts(
    files: DataFrame,
    patterns: Patterns = DEFAULT_PATTERNS,
    max_line_bytes: int | None = None,
) -> DataFrame:
    """Facts of code and Dockerfiles, and failures, from one read of ``files``."""
    return _facts_of(files, (DOCKER, SOURCE), patterns, max_line_bytes)


def extract_env_facts(env_files: DataFrame, max_line_bytes: int | None = None) -> DataFrame:
    """Declarations in env files, and failures, in the shape of ``extract_facts``."""
    of = _env_expressions(max_line_bytes)
    lines = (
        env_files.withColumn("failed", of.failed)
        .select("project", F.col("env_path").alias("path"), "ordinal", "failed", of.lines)
        .withColumn("line_no", F.when(F.col("failed").isNull(), F.col("pos") + 1))
        .where(of.may_have_fact)
    )
    return _fact_rows(lines, of.found, F.col("ordinal"))


@built_once
def _env_expressions(max_line_bytes: int | None) -> _Expressions:
    content, text, failed = F.col("content"), F.col("text"), F.col("failed")
    nameless = F.array(_found(failed, F.array(F.lit(None).cast("string"))))
    declared = F.array(_found(ENV_DECLARED, _first_group(trim_space(text), rf"\A({NAME}){BLANK}*=")))
    return _Expressions(
        failed=failure(content, max_line_bytes),
        relevant=F.lit(True),
        lines=_pieces(failed, content),
        may_have_fact=failed.isNotNull() | text.contains("="),
        text=text,
        found=F.when(failed.isNotNull(), nameless).otherwise(declared),
    )


def env_declarations(env_files: DataFrame, max_line_bytes: int | None = None) -> DataFrame:
    """Variables each env file declares, each once per file."""
    facts = extract_env_facts(env_files, max_line_bytes)
    return env_declarations_of(facts)


def env_declarations_of(facts: DataFrame) -> DataFrame:
    return env_occurrences_of(facts).distinct()


def env_occurrences_of(facts: DataFrame) -> DataFrame:
    """Declarations as often as they are written; enough for what groups or subtracts them."""
    return facts.where(F.col("role") == ENV_DECLARED).select(
        "project", "ordinal", F.col("path").alias("env_path"), "variable"
    )


def uses_of(facts: DataFrame, role: str) -> DataFrame:
    """Occurrences with the given role."""
    return facts.where(F.col("role") == role).select("project", "path", "line_no", "variable")


def code_references(
    files: DataFrame,
    patterns: Patterns = DEFAULT_PATTERNS,
    max_line_bytes: int | None = None,
) -> DataFrame:
    """Variables read in source files, one row per occurrence."""
    return uses_of(_facts_of(files, (SOURCE,), patterns, max_line_bytes), CODE_USED)


def _language_references(files: DataFrame, exts: Iterable[str], regexes, max_line_bytes) -> DataFrame:
    return code_references(files, {ext: regexes for ext in exts}, max_line_bytes)


def js_references(files: DataFrame, max_line_bytes: int | None = None) -> DataFrame:
    return _language_references(files, (".js", ".ts"), JS_PATTERNS, max_line_bytes)


def go_references(files: DataFrame, max_line_bytes: int | None = None) -> DataFrame:
    return _language_references(files, (".go",), GO_PATTERNS, max_line_bytes)


def python_references(files: DataFrame, max_line_bytes: int | None = None) -> DataFrame:
    return _language_references(files, (".py",), PYTHON_PATTERNS, max_line_bytes)


def valid_dockerfiles(files: DataFrame, max_line_bytes: int | None = None) -> DataFrame:
    """Dockerfiles that can be read and have a FROM instruction; all columns kept."""
    content = F.col("content")
    dockerfiles = classify_files(files).where(F.col("kind") == DOCKER).select(*files.columns)
    return dockerfiles.where(
        failure(content, max_line_bytes).isNull() & _has_from(join_continued(content))
    )


def _instruction_declarations(lines: DataFrame, word: str, names: Column) -> DataFrame:
    return (
        significant_lines(lines)
        .where(_instruction(F.col("text"), word))
        .select("project", "path", "line_no", F.explode(names).alias("variable"))
        .where(F.col("variable") != "")
    )


def docker_env_declarations(logical_lines: DataFrame) -> DataFrame:
    """Variables ENV instructions declare."""
    return _instruction_declarations(logical_lines, "ENV", _env_instruction_names(F.col("text")))


def docker_arg_declarations(logical_lines: DataFrame) -> DataFrame:
    """Variables ARG instructions declare."""
    return _instruction_declarations(logical_lines, "ARG", _arg_instruction_names(F.col("text")))


def docker_references(logical_lines: DataFrame) -> DataFrame:
    """Variables used in Dockerfiles, once per line."""
    with_use = logical_lines.where(F.col("text").contains("$"))
    return significant_lines(with_use).select(
        "project", "path", "line_no", F.explode(_docker_used_names(F.col("text"))).alias("variable")
    )


def docker_declarations(files: DataFrame, max_line_bytes: int | None = None) -> DataFrame:
    """Variables declared in any stage of any Dockerfile of a project."""
    return docker_declarations_of(_facts_of(files, (DOCKER,), DEFAULT_PATTERNS, max_line_bytes))


def docker_declarations_of(facts: DataFrame) -> DataFrame:
    return facts.where(F.col("role") == DOCKER_DECLARED).select("project", "variable").distinct()
