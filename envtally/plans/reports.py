"""Reports.

A report is an ordered relation of small pieces of text, not one string per project: the
pieces of a project, put together in order, are its report. So a project with any number
of findings is rendered and written by many tasks, and no row or task has to hold it.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from envtally.functions.json import json_location, json_string
from envtally.functions.paths import to_slash, walk_key
from envtally.operators.extract import CODE_USED, uses_of
from envtally.operators.ordering import with_item_and_part, with_position
from envtally.operators.reconcile import PAIR, pair_findings, rule_tests
from envtally.operators.rules import RULES
from envtally.operators.skew import hot_keys, salted_join
from envtally.plans.scan import ScanResult

TOOL_NAME = "envtally"
TOOL_URI = "https://example.org/envtally"

# The lines and the order of the text report, the format's version and schema.
NO_MISMATCH = "No environment mismatches found."
TEXT_HEADINGS = {
    "ENV001": "Declared but unused:",
    "ENV002": "Used but not declared:",
    "ENV003": "Code uses variables not in Dockerfile or .env:",
    "ENV004": "Dockerfile declares but code doesn't use:",
    "ENV005": "Dockerfile uses undeclared variables:",
}
SARIF_VERSION = "2.1.0"
SARIF_SCHEMA = (
    "https://raw.githubusercontent.com/oasis-tcs/sarif-spec/main/sarif-2.1/schema/"
    "sarif-schema-2.1.0.json"
)


def _section_of(rule_sections: dict[str, int]) -> Column:
    section = F.when(F.lit(False), F.lit(0))
    for rule_id, number in rule_sections.items():
        section = section.when(F.col("rule_id") == rule_id, F.lit(number))
    return section


def _pieces(totals: DataFrame, fields: tuple[str, ...], rows: list[Column]) -> DataFrame:
    """Rows each project's totals give rise to; NULL structs are left out."""
    return (
        totals.select("project", F.explode(F.array(*rows)).alias("piece"))
        .where(F.col("piece").isNotNull())
        .select("project", *[f"piece.{field}" for field in fields])
    )


def text_report(result: ScanResult) -> DataFrame:
    """``project, line_no, text``."""
    result = result.with_pinned_pairs()
    sections = {rule.rule_id: n for n, rule in enumerate(RULES, 1)}
    has = {rule.rule_id: F.col(rule.rule_id) > 0 for rule in RULES}

    def line(section: int, sub: int, text: str) -> Column:
        return F.struct(
            F.lit(section).alias("section"),
            F.lit(sub).alias("sub"),
            F.lit("").alias("variable"),
            F.lit(text).alias("text"),
        )

    rows = [F.when(~has["ENV001"] & ~has["ENV002"], line(0, 0, NO_MISMATCH))]
    for rule_id, section in sections.items():
        if rule_id == "ENV002":
            rows.append(F.when(has["ENV001"] & has["ENV002"], line(section, 0, "")))
        elif rule_id != "ENV001":
            rows.append(F.when(has[rule_id], line(section, 0, "")))
        rows.append(F.when(has[rule_id], line(section, 1, TEXT_HEADINGS[rule_id])))
    order = ("section", "sub", "variable")
    headings = _pieces(result.report_totals, (*order, "text"), rows)
    place = F.concat(F.lit(" ("), "path", F.lit(":"), F.col("line_no").cast("string"), F.lit(")"))
    items = result.findings.select(
        "project",
        _section_of(sections).alias("section"),
        F.lit(2).alias("sub"),
        "variable",
        F.concat(F.lit("- "), "variable", F.coalesce(place, F.lit(""))).alias("text"),
    )
    of_all = pair_findings(result.pairs).select(
        "project", _section_of(sections).alias("section"), F.lit(2).alias("sub"), "variable"
    )
    numbered = with_position(headings.unionByName(items), ("project",), order, "line_no", of_all)
    return numbered.select("project", "line_no", "text")


def json_report(result: ScanResult) -> DataFrame:
    """``project, section, item, part, text``: in this order, the pieces of a JSON object."""
    result = result.pinned()
    order = ("section", "item", "part")

    def opening(section: int, *text: str | Column) -> Column:
        return F.struct(
            F.lit(section).alias("section"),
            F.lit(0).cast("long").alias("item"),
            F.lit(0).cast("long").alias("part"),
            F.concat(*[F.lit(t) if isinstance(t, str) else t for t in text]).alias("text"),
        )

    def last_closed(rule_id: str) -> Column:
        """What ends the last variable with locations, where there is one."""
        return F.when(F.col(rule_id) > 0, "]}").otherwise("")

    summary = F.to_json(
        F.struct("files_scanned", "variables_declared", "variables_used", "mismatches_found")
    )
    skeleton = _pieces(
        result.report_totals,
        (*order, "text"),
        [
            opening(1, '{"summary":', summary, ',"unused":['),
            opening(2, '],"missing":['),
            opening(3, last_closed("ENV002"), '],"declared_sources":{'),
            opening(4, '},"dockerfile_issues":{"code_uses_not_in_docker":['),
            opening(5, last_closed("ENV003"), '],"docker_declares_unused":['),
            opening(6, '],"docker_uses_undeclared":['),
            opening(7, "]}}"),
        ],
    )

    sections = {"ENV001": 1, "ENV002": 2, "ENV003": 4, "ENV004": 5, "ENV005": 6}
    name = json_string(F.col("variable"))
    place = json_location(F.col("path"), F.col("line_no"))
    section = F.col("section")
    source = F.concat(name, F.lit(":"), json_string(F.col("path")))
    located = F.concat(F.lit('{"variable":'), name, F.lit(',"location":'), place, F.lit("}"))
    opened = F.concat(F.lit('{"variable":'), name, F.lit(',"locations":['))
    head = F.when(section.isin(1, 5), name).when(section == 3, source).when(section == 6, located).otherwise(opened)
    sources = result.env_precedence.select(
        "project", F.lit(3).alias("section"), "variable", F.col("declared_source").alias("path")
    )
    heads = (
        result.findings.select("project", _section_of(sections).alias("section"), "variable", "path", "line_no")
        .unionByName(sources, allowMissingColumns=True)
        .select(
            "project", "section", "variable", F.lit(False).alias("is_part"),
            F.lit("").alias("key"), F.lit(0).alias("line_no"), head.alias("text"),
        )
    )

    # A variable of section 4 is in section 2 too; its uses are joined once.
    tests = rule_tests()
    missing = result.pairs.where(tests["ENV002"]).select(
        *PAIR, F.when(tests["ENV003"], F.array(F.lit(2), F.lit(4))).otherwise(F.array(F.lit(2))).alias("sections")
    ).join(result.auditable, "project", "left_semi")
    uses = uses_of(result.facts, CODE_USED)
    hot = hot_keys(result.pairs, PAIR, "uses")
    parts = salted_join(uses, missing, PAIR, "path", hot).select(
        "project", F.explode("sections").alias("section"), "variable", F.lit(True).alias("is_part"),
        walk_key(F.col("path")).alias("key"), "line_no", place.alias("text"),
    )
    numbered = with_item_and_part(
        heads.unionByName(parts), ("project", "section"), "variable", ("key", "line_no"),
        sampled=_keys_of_uses(result),
    )
    comma = (
        F.when(F.when(F.col("is_part"), F.col("part")).otherwise(F.col("item")) == 1, "")
        .when(~F.col("is_part") & section.isin(2, 4), "]},")
        .otherwise(",")
    )
    pieces = numbered.select("project", *order, F.concat(comma, "text").alias("text"))
    return skeleton.select("project", *order, "text").unionByName(pieces)


def _keys_of_uses(result: ScanResult) -> DataFrame:
    """About the keys of the pieces of a JSON report, without a join: those of all uses and
    of all variables, as if each were missing."""
    uses = uses_of(result.facts, CODE_USED).select(
        *PAIR, F.lit(True).alias("is_part"), walk_key(F.col("path")).alias("key"), "line_no"
    )
    variables = result.pairs.select(*PAIR, F.lit(False).alias("is_part"), F.lit("").alias("key"), F.lit(0).alias("line_no"))
    section = F.when(F.col("is_part"), F.array(F.lit(2), F.lit(4))).otherwise(F.array(F.lit(1), F.lit(3), F.lit(5)))
    return uses.unionByName(variables).withColumn("section", F.explode(section))


def sarif_rules(
    result: ScanResult, tool_uri: str = TOOL_URI
) -> DataFrame:
    """Rules with findings, numbered from 0 within each project."""
    rows, index = [], F.lit(0)
    for rule in RULES:
        active = F.col(rule.rule_id) > 0
        row = F.struct(
            F.lit(rule.rule_id).alias("rule_id"),
            index.alias("rule_index"),
            F.lit(rule.name).alias("name"),
            F.lit(rule.description).alias("description"),
            F.lit(f"{tool_uri}#{rule.name}").alias("help_uri"),
        )
        rows.append(F.when(active, row))
        index = index + active.cast("int")
    return _pieces(
        result.report_totals, ("rule_id", "rule_index", "name", "description", "help_uri"), rows
    )


def sarif_results(result: ScanResult) -> DataFrame:
    """Findings in the order of a SARIF document: by rule, then by message text."""
    result = result.with_pinned_pairs()
    index = F.lit(None).cast("int")
    for number, rule in enumerate(RULES):
        before = sum(((F.col(r.rule_id) > 0).cast("int") for r in RULES[:number]), F.lit(0))
        index = F.when(F.col("rule_id") == rule.rule_id, before).otherwise(index)
    # One row for each project, the same that leaves out those that get no report.
    counts = result.report_totals.select("project", *[rule.rule_id for rule in RULES])
    indexed = (
        pair_findings(result.pairs)
        .join(counts, "project")
        .withColumn("rule_index", index)
        .drop(*[rule.rule_id for rule in RULES])
    )
    of_all = pair_findings(result.pairs)
    return with_position(indexed, ("project",), ("rule_id", "message"), "pos", of_all).select(
        "project", "pos", "rule_id", "rule_index", "level", "variable", "message",
        "path", "line_no", "declared_source",
    )


def sarif_report(
    result: ScanResult,
    tool_name: str = TOOL_NAME,
    tool_uri: str = TOOL_URI,
    windows_paths: bool = False,
) -> DataFrame:
    """``project, pos, text``: in this order, the pieces of a SARIF 2.1.0 document.

    With ``windows_paths`` backslashes become slashes; elsewhere they are part of a name.
    """
    result = result.with_pinned_pairs()

    def uri(path: Column) -> Column:
        return to_slash(path) if windows_paths else path

    descriptors = F.concat_ws(
        ",",
        *[
            F.when(
                F.col(rule.rule_id) > 0,
                F.lit(
                    json.dumps(
                        {
                            "id": rule.rule_id,
                            "name": rule.name,
                            "shortDescription": {"text": rule.description},
                            "helpUri": f"{tool_uri}#{rule.name}",
                        },
                        separators=(",", ":"),
                    )
                ),
            )
            for rule in RULES
        ],
    )
    rules = F.when(descriptors == "", F.lit("null")).otherwise(
        F.concat(F.lit("["), descriptors, F.lit("]"))
    )
    head = (
        f'{{"version":{json.dumps(SARIF_VERSION)},"$schema":{json.dumps(SARIF_SCHEMA)},"runs":'
        f'[{{"tool":{{"driver":{{"name":{json.dumps(tool_name)},'
        f'"informationUri":{json.dumps(tool_uri)},"rules":'
    )
    envelope = _pieces(
        result.report_totals,
        ("pos", "text"),
        [
            F.struct(
                F.lit(0).cast("long").alias("pos"),
                F.concat(F.lit(head), rules, F.lit('}},"results":[')).alias("text"),
            ),
            F.struct((F.col("mismatches_found") + 1).alias("pos"), F.lit("]}]}").alias("text")),
        ],
    )
    location = F.struct(
        F.struct(
            F.struct(uri(F.col("path")).alias("uri")).alias("artifactLocation"),
            F.struct(F.col("line_no").alias("startLine")).alias("region"),
        ).alias("physicalLocation")
    )
    entry = F.to_json(
        F.struct(
            F.col("rule_id").alias("ruleId"),
            F.col("rule_index").alias("ruleIndex"),
            "level",
            F.struct(F.col("message").alias("text")).alias("message"),
            F.when(F.col("path") != "", F.array(location)).alias("locations"),
            F.when(
                F.col("declared_source") != "",
                F.struct(uri(F.col("declared_source")).alias("declared_source")),
            ).alias("properties"),
        )
    )
    comma = F.when(F.col("pos") > 1, F.lit(",")).otherwise(F.lit(""))
    entries = sarif_results(result).select(
        "project", F.col("pos").cast("long").alias("pos"), F.concat(comma, entry).alias("text")
    )
    return envelope.unionByName(entries)


_FORMATS = {
    "text": (text_report, ("line_no",)),
    "json": (json_report, ("section", "item", "part")),
    "sarif": (sarif_report, ("pos",)),
}


def write_reports(result: ScanResult, path: str, format: str = "text", mode: str = "error") -> None:
    """Write one report per project below ``path/project=<name>``, and a manifest of its files.

    A large report spans several files; the manifest, a table beside ``path``, says in which
    order (``read_manifest``).
    """
    if format not in _FORMATS:
        raise ValueError(f"invalid format {format!r}: must be one of {', '.join(_FORMATS)}")
    report, order = _FORMATS[format]
    (
        report(result)
        .repartitionByRange("project", *order)
        .sortWithinPartitions("project", *order)
        .select("project", "text")
        .write.mode(mode)
        .partitionBy("project")
        .text(path)
    )
    _write_manifest(result.files.sparkSession, path)


def _manifest(path: str) -> str:
    return f"{path.rstrip('/')}.manifest"


def _write_manifest(spark: SparkSession, path: str) -> None:
    """List the files below ``path``. They hold ranges of lines, in the order of their names.

    Only names and sizes are read, no texts.
    """
    kind = "path string, modificationTime timestamp, length bigint, content binary, project string"
    files = spark.read.format("binaryFile").schema(kind).option("pathGlobFilter", "part-*").load(path)
    named = files.select("project", F.element_at(F.split("path", "/"), -1).alias("file_name"), F.col("length").alias("bytes"))
    part = F.row_number().over(Window.partitionBy("project").orderBy("file_name"))
    named.select("project", part.alias("part"), "file_name", "bytes").write.mode("overwrite").parquet(_manifest(path))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """``project, part, file_name, bytes`` of the reports that were written to ``path``.

    The texts of a project's files, one after the other by part, are its report. There are as
    many rows per project as tasks wrote parts of it.
    """
    return spark.read.parquet(_manifest(path))
