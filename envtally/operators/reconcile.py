"""Declared against used.

Two ways to the same answers. The small operators take two relations and subtract one
from the other. ``reconcile`` takes all facts and folds them into one row per
(project, variable), from which every finding and count follows without a join; partial
aggregation leaves at most one row per task for a hot variable before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from envtally.functions.paths import path_of_walk_key, walk_key
from envtally.functions.reuse import built_once
from envtally.operators.extract import CODE_USED, DOCKER_DECLARED, DOCKER_USED, ENV_DECLARED
from envtally.operators.ordering import with_position
from envtally.operators.pinning import pin
from envtally.operators.rules import RULES

PAIR = ("project", "variable")
#: What is counted per project, beside its variables.
COUNTS = ("files_scanned", "unlistable", "readable_env_files")


def _place() -> Column:
    return F.struct(walk_key(F.col("path")).alias("key"), F.col("line_no").alias("line_no"))


def _path(place: str) -> Column:
    return path_of_walk_key(F.col(f"{place}.key"))


def env_precedence(env_declarations: DataFrame) -> DataFrame:
    """The last env file that declares each variable."""
    return env_declarations.groupBy(*PAIR).agg(
        F.max_by("env_path", "ordinal").alias("declared_source")
    )


def used_variables(references: DataFrame) -> DataFrame:
    return references.select(*PAIR).distinct()


def all_locations(references: DataFrame) -> DataFrame:
    """Every occurrence, with its position among those of its variable in walk order.

    The references are pinned first, so that sampling their ranges reads no text again.
    """
    keyed = pin(references.select(*PAIR, walk_key(F.col("path")).alias("key"), "line_no"))
    return with_position(keyed, PAIR, ("key", "line_no"), "pos").select(
        *PAIR, "pos", path_of_walk_key(F.col("key")).alias("path"), "line_no"
    )


def first_locations(references: DataFrame) -> DataFrame:
    """The first occurrence of each variable in walk order."""
    return (
        references.groupBy(*PAIR)
        .agg(F.min(_place()).alias("first"))
        .select(*PAIR, _path("first").alias("path"), F.col("first.line_no").alias("line_no"))
    )


def docker_first_locations(docker_references: DataFrame) -> DataFrame:
    return first_locations(docker_references)


def _minus(left: DataFrame, *right: DataFrame) -> DataFrame:
    """Rows of ``left`` whose pair is in none of ``right``; pairs are distinct on both sides."""
    subtrahend = right[0].select(*PAIR)
    for other in right[1:]:
        subtrahend = subtrahend.unionByName(other.select(*PAIR))
    return left.join(subtrahend.distinct(), list(PAIR), "left_anti")


def unused(declared: DataFrame, used: DataFrame) -> DataFrame:
    """Declared in an env file, not used in code."""
    return _minus(declared.select(*PAIR).distinct(), used)


def missing(declared: DataFrame, references: DataFrame) -> DataFrame:
    """Used in code, not declared in an env file."""
    return _minus(first_locations(references), declared)


def code_uses_not_in_docker(facts: DataFrame) -> DataFrame:
    """Used in code, declared neither in a Dockerfile nor in an env file."""
    return _broken(facts, (CODE_USED, DOCKER_DECLARED, ENV_DECLARED), "ENV003").select(
        *PAIR, F.col("use_path").alias("path"), F.col("use_line").alias("line_no")
    )


def docker_declares_unused(facts: DataFrame) -> DataFrame:
    """Declared in a Dockerfile, not used in code."""
    return _broken(facts, (DOCKER_DECLARED, CODE_USED), "ENV004").select(*PAIR)


def docker_uses_undeclared(facts: DataFrame) -> DataFrame:
    """Used in a Dockerfile, declared in none; env files do not count."""
    return _broken(facts, (DOCKER_USED, DOCKER_DECLARED), "ENV005").select(
        *PAIR, F.col("docker_path").alias("path"), F.col("docker_line").alias("line_no")
    )


def _broken(facts: DataFrame, roles: tuple[str, ...], rule_id: str) -> DataFrame:
    """Variables that break a rule, by one aggregate of the facts it looks at."""
    return reconcile(facts.where(F.col("role").isin(*roles))).where(rule_tests()[rule_id])


def reconcile(facts: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """All that is known of each (project, variable).

    With ``counts`` there is one more row per project, which has no variable but the sums of
    COUNTS: variables and counts of a project then come from one shuffle.
    """
    rows = facts.where(F.col("variable").isNotNull())
    columns, sums = _folded()
    if counts is None:
        return rows.groupBy(*PAIR).agg(*columns).select(*PAIR, *_known())
    union = rows.unionByName(counts, allowMissingColumns=True)
    return union.groupBy(*PAIR).agg(*columns, *sums).select(*PAIR, *_known(), *COUNTS)


@built_once
def _folded() -> tuple[list[Column], list[Column]]:
    """Aggregates of facts, and of counts."""

    def has(role: str) -> Column:
        return F.col("role") == role

    def first(role: str) -> Column:
        return F.min(F.when(has(role), _place()))

    facts = [
        F.max(F.when(has(ENV_DECLARED), F.struct("ordinal", "path"))).alias("last_env"),
        F.coalesce(F.max(has(DOCKER_DECLARED)), F.lit(False)).alias("docker_declared"),
        F.sum(has(CODE_USED).cast("long")).alias("uses"),
        first(CODE_USED).alias("first_use"),
        first(DOCKER_USED).alias("first_docker_use"),
    ]
    return facts, [F.sum(c).alias(c) for c in COUNTS]


@built_once
def _known() -> list[Column]:
    return [
        F.col("last_env").isNotNull().alias("env_declared"),
        F.col("last_env.path").alias("declared_source"),
        F.col("docker_declared"),
        F.col("uses"),
        F.coalesce(F.col("uses") > 0, F.lit(False)).alias("code_used"),
        _path("first_use").alias("use_path"),
        F.col("first_use.line_no").alias("use_line"),
        F.col("first_docker_use").isNotNull().alias("docker_used"),
        _path("first_docker_use").alias("docker_path"),
        F.col("first_docker_use.line_no").alias("docker_line"),
    ]


@built_once
def rule_tests() -> dict[str, Column]:
    """For each rule, when a row of ``reconcile`` breaks it."""
    env, code = F.col("env_declared"), F.col("code_used")
    docker, docker_use = F.col("docker_declared"), F.col("docker_used")
    return {
        "ENV001": env & ~code,
        "ENV002": code & ~env,
        "ENV003": code & ~env & ~docker,
        "ENV004": docker & ~code,
        "ENV005": docker_use & ~docker,
    }


@built_once
def _finding() -> tuple[Column, list[Column]]:
    """The rules that a row of ``reconcile`` breaks, exploded, and the columns of each."""
    nothing = F.lit(None).cast("string"), F.lit(None).cast("int")
    use = F.col("use_path"), F.col("use_line")
    places = {
        "ENV001": nothing,
        "ENV002": use,
        "ENV003": use,
        "ENV004": nothing,
        "ENV005": (F.col("docker_path"), F.col("docker_line")),
    }
    tests = rule_tests()
    broken = []
    for rule in RULES:
        path, line_no = places[rule.rule_id]
        source = F.col("declared_source") if rule.rule_id == "ENV001" else F.lit(None).cast("string")
        row = F.struct(
            F.lit(rule.rule_id).alias("rule_id"),
            F.lit(rule.level).alias("level"),
            F.concat("variable", F.lit(f": {rule.description}")).alias("message"),
            path.alias("path"),
            line_no.alias("line_no"),
            source.alias("declared_source"),
        )
        broken.append(F.when(tests[rule.rule_id], row))
    names = ("rule_id", "level", "variable", "message", "path", "line_no", "declared_source")
    columns = [F.col(name if name == "variable" else f"finding.{name}") for name in names]
    return F.explode(F.array(*broken)).alias("finding"), columns


def pair_findings(pairs: DataFrame) -> DataFrame:
    """One row per broken rule and variable."""
    finding, columns = _finding()
    found = pairs.select(*PAIR, finding).where(F.col("finding").isNotNull())
    return found.select("project", *columns)
