"""The audit of a fleet of projects."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from envtally.functions.names import DEFAULT_PATTERNS, Patterns
from envtally.operators.extract import FAILURES, extract_env_facts, extract_facts
from envtally.operators.ordering import whole
from envtally.operators.pinning import pin
from envtally.operators.reconcile import COUNTS, pair_findings, reconcile, rule_tests
from envtally.sources.tables import (
    candidate_files,
    classify_files,
    counted_files,
    project_counts,
    prune_ignored,
    readable_projects,
)


@dataclass(frozen=True)
class ScanResult:
    """Lazy results of one audit.

    ``files`` has every file with the number of times a scan counts it. ``facts`` are
    ``extract_facts`` of all texts, ``folded`` what ``reconcile`` makes of them and, if
    ``counts_folded``, of the counts of the projects. Unless they are pinned, each result
    reads the texts anew.
    """

    files: DataFrame
    env_files: DataFrame
    facts: DataFrame
    folded: DataFrame
    extensions: tuple[str, ...]
    max_line_bytes: int | None
    counts_folded: bool = True
    facts_pinned: bool = False
    pairs_pinned: bool = False

    def pinned(self) -> ScanResult:
        """For use of more than one result: the texts are read once, here."""
        if self.facts_pinned:
            return self.with_pinned_pairs()
        facts = pin(self.facts)
        pinned = replace(self, facts=facts, folded=reconcile(facts), counts_folded=False, facts_pinned=True)
        return pinned.with_pinned_pairs()

    def with_pinned_pairs(self) -> ScanResult:
        """Enough for use of findings and counts more than once, and less to write."""
        if self.pairs_pinned:
            return self
        return replace(self, folded=pin(self.folded), pairs_pinned=True)

    @cached_property
    def pairs(self) -> DataFrame:
        """One row per project and variable. The counts of projects are read only with those."""
        if self.pairs_pinned:
            return self.folded.where(F.col("variable").isNotNull()).drop(*COUNTS)
        return reconcile(self.facts)

    @cached_property
    def auditable(self) -> DataFrame:
        """Projects with an env file that can be read; the others get no report."""
        if self.pairs_pinned:
            return self.report_totals.select("project")
        unknown = self.files.where("unlistable").select("project").distinct()
        return readable_projects(self.env_files, self.max_line_bytes).join(
            unknown, "project", "left_anti"
        )

    def _of_auditable(self, rows: DataFrame) -> DataFrame:
        """Rows of projects that can be audited. Of a hot project, adaptive execution splits
        the rows; the other side has one row per project."""
        return rows.join(self.auditable, "project", "left_semi")

    @cached_property
    def findings(self) -> DataFrame:
        return self._of_auditable(pair_findings(self.pairs))

    @cached_property
    def env_precedence(self) -> DataFrame:
        declared = self.pairs.where(F.col("env_declared"))
        return self._of_auditable(declared.select("project", "variable", "declared_source"))

    @cached_property
    def totals(self) -> DataFrame:
        """Counts of every project: files, variables, findings by rule, env files.

        One more aggregate of what is folded already. The file count needs paths only, so it
        does not read the texts.
        """
        rules = rule_tests()
        measures = {
            "files_scanned": F.col("files_scanned"),
            "variables_declared": F.col("env_declared").cast("long"),
            "variables_used": F.col("code_used").cast("long"),
            **{rule: test.cast("long") for rule, test in rules.items()},
            "readable_env_files": F.col("readable_env_files"),
            "unlistable": F.col("unlistable"),
        }
        folded = self.folded
        if not self.counts_folded:
            counts = project_counts(self.files, self.env_files, self.max_line_bytes)
            folded = folded.unionByName(counts, allowMissingColumns=True)
        totals = folded.groupBy("project").agg(
            *[F.coalesce(F.sum(m), F.lit(0).cast("long")).alias(name) for name, m in measures.items()]
        ).withColumn("mismatches_found", reduce(Column.__add__, map(F.col, rules)))
        if not self.counts_folded:
            return pin(totals)
        # Every part of a report needs them, from one exchange.
        return whole(totals) if self.pairs_pinned else totals

    @cached_property
    def report_totals(self) -> DataFrame:
        return self.totals.where((F.col("readable_env_files") > 0) & (F.col("unlistable") == 0))

    @cached_property
    def summary(self) -> DataFrame:
        return self.report_totals.select(
            "project", "files_scanned", "variables_declared", "variables_used", "mismatches_found"
        )

    @cached_property
    def gate(self) -> DataFrame:
        """2: cannot be audited, 1: has findings, 0: clean."""
        return self.totals.select(
            "project",
            F.when((F.col("readable_env_files") == 0) | (F.col("unlistable") > 0), 2)
            .when(F.col("mismatches_found") > 0, 1)
            .otherwise(0)
            .alias("status"),
        )

    @cached_property
    def warnings(self) -> DataFrame:
        """Files that could not be read, once for each time a scan comes across them, and
        directories that could not be listed.

        The files of a project that cannot be audited are never looked at.
        """
        failed = self.facts.where(F.col("role").isin(*FAILURES))
        in_env = failed.where(F.col("ordinal").isNotNull()).select(
            "project", "path", F.lit("env").alias("stage"), F.col("role").alias("reason")
        )
        in_files = (
            classify_files(failed.where(F.col("ordinal").isNull()), self.extensions)
            .select(
                "project",
                "path",
                F.when(F.col("kind") == "docker", "dockerfile").otherwise("source").alias("stage"),
                F.col("role").alias("reason"),
                F.explode(F.sequence(F.lit(1), F.col("multiplicity"))).alias("times"),
            )
            .drop("times")
        )
        directories = self.files.where("unlistable").select(
            "project", "path", F.lit("walk").alias("stage"), F.lit("unlistable").alias("reason")
        )
        return in_env.unionByName(self._of_auditable(in_files)).unionByName(directories)


def scan(
    files: DataFrame,
    env_files: DataFrame,
    ignore: str | Iterable[str] = (),
    patterns: Patterns = DEFAULT_PATTERNS,
    max_line_bytes: int | None = None,
) -> ScanResult:
    """Audit every project of ``files`` against its ``env_files``."""
    kept = prune_ignored(candidate_files(files, patterns), ignore)
    facts = extract_facts(kept, patterns, max_line_bytes).unionByName(
        extract_env_facts(env_files, max_line_bytes)
    )
    counted = counted_files(files, ignore, patterns)
    return ScanResult(
        files=counted,
        env_files=env_files,
        facts=facts,
        folded=reconcile(facts, project_counts(counted, env_files, max_line_bytes)),
        extensions=tuple(patterns),
        max_line_bytes=max_line_bytes,
    )


def findings(files: DataFrame, env_files: DataFrame, *options, **more) -> DataFrame:
    """Findings of a ``scan`` with these options."""
    return scan(files, env_files, *options, **more).findings


def warnings(files: DataFrame, env_files: DataFrame, *options, **more) -> DataFrame:
    """Warnings of a ``scan`` with these options."""
    return scan(files, env_files, *options, **more).warnings


def summary(files: DataFrame, env_files: DataFrame, *options, **more) -> DataFrame:
    """Summary of a ``scan`` with these options."""
    return scan(files, env_files, *options, **more).summary


def gate(files: DataFrame, env_files: DataFrame, *options, **more) -> DataFrame:
    """Gate of a ``scan`` with these options."""
    return scan(files, env_files, *options, **more).gate
