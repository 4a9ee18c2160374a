from __future__ import annotations

import json
from collections import defaultdict

import pytest
from fleet import LIMIT, random_fleet, tables_of
from helpers import env_files_of, files_of, rows
from pyspark.sql import functions as F

import brute
from envtally import DEFAULT_PATTERNS, scan
from envtally.operators import extract as X
from envtally.operators import reconcile as R
from envtally.plans import reports


@pytest.fixture(scope="module", params=[1, 2])
def audited(request, spark):
    fleet = random_fleet(request.param, 60)
    expected = {
        p: brute.audit(files, env, ["gen"], LIMIT) for p, (files, env) in fleet.items() if files or env
    }
    result = scan(*tables_of(spark, fleet), ignore="gen", max_line_bytes=LIMIT)
    return result, result.pinned(), expected


def reported(expected):
    return {p: e for p, e in expected.items() if e["gate"] != 2}


def by_project(df, *columns):
    groups = defaultdict(list)
    for row in df.select("project", *columns).collect():
        groups[row[0]].append(tuple(row[1:]))
    return dict(groups)


def test_the_fleet_reaches_every_rule_and_gate(audited):
    expected = audited[2]
    assert {e["gate"] for e in expected.values()} >= {1, 2}
    assert {f[0] for e in reported(expected).values() for f in e["findings"]} == set(reports.TEXT_HEADINGS)
    assert {w[1:] for e in expected.values() for w in e["warnings"]} == {
        (stage, reason) for stage in ("env", "dockerfile", "source") for reason in ("unreadable", "oversize")
    }


def test_findings(audited):
    result, pinned, expected = audited
    for scanned in (result, pinned):
        got = by_project(scanned.findings, "rule_id", "variable", "path", "line_no", "declared_source")
        want = {p: e["findings"] for p, e in reported(expected).items() if e["findings"]}
        assert {p: sorted(f, key=str) for p, f in got.items()} == want


def test_findings_do_not_depend_on_the_layout_of_the_input(spark):
    fleet = random_fleet(7, 20)
    files, env = tables_of(spark, fleet)
    first = rows(scan(files, env).findings)
    shuffled = scan(files.orderBy(F.rand(3)).repartition(7), env.repartition(3, "env_path"))
    assert rows(shuffled.findings) == first


def test_summary_gate_and_warnings(audited):
    result, pinned, expected = audited
    for scanned in (result, pinned):
        assert {r[0]: tuple(r[1:]) for r in scanned.summary.collect()} == {
            p: e["summary"] for p, e in reported(expected).items()
        }
        assert dict(tuple(r) for r in scanned.gate.collect()) == {p: e["gate"] for p, e in expected.items()}
        got = by_project(scanned.warnings, "path", "stage", "reason")
        assert {p: sorted(w) for p, w in got.items()} == {
            p: sorted(e["warnings"]) for p, e in expected.items() if e["warnings"]
        }


def test_findings_are_the_five_differences(audited):
    _, result, _ = audited
    declared = X.env_declarations_of(result.facts)
    uses = X.uses_of(result.facts, X.CODE_USED)
    used = R.used_variables(uses)
    differences = {
        "ENV001": R.unused(declared, used),
        "ENV002": R.missing(declared, uses),
        "ENV003": R.code_uses_not_in_docker(result.facts),
        "ENV004": R.docker_declares_unused(result.facts),
        "ENV005": R.docker_uses_undeclared(result.facts),
    }
    for rule, difference in differences.items():
        found = result.findings.where(F.col("rule_id") == rule)
        kept = difference.join(result.auditable, "project", "left_semi")
        assert rows(kept, *difference.columns) == rows(found, *difference.columns), rule
    sources = R.env_precedence(declared).join(result.auditable, "project", "left_semi")
    columns = ("project", "variable", "declared_source")
    assert rows(sources, *columns) == rows(result.env_precedence, *columns)


def test_all_locations_are_in_walk_order(audited):
    _, result, expected = audited
    uses = X.uses_of(result.facts, X.CODE_USED).join(result.auditable, "project", "left_semi")
    got = defaultdict(list)
    for row in R.all_locations(uses).orderBy("pos").collect():
        got[row.project, row.variable].append((row.path, row.line_no))
        assert row.pos == len(got[row.project, row.variable])
    assert got == {
        (p, v): places for p, e in reported(expected).items() for v, places in e["locations"].items()
    }


def assembled(report, *order):
    texts = defaultdict(str)
    for row in report.orderBy("project", *order).collect():
        texts[row.project] += row.text
    return texts


def test_text_report(audited):
    _, result, expected = audited
    lines = by_project(reports.text_report(result), "line_no", "text")
    for project, e in reported(expected).items():
        want = list(enumerate(brute.text_report(e), 1))
        assert sorted(lines.pop(project)) == want
    assert not lines


def test_json_report(audited):
    _, result, expected = audited
    texts = assembled(reports.json_report(result), "section", "item", "part")
    assert {p: json.loads(t) for p, t in texts.items()} == {
        p: brute.json_report(e) for p, e in reported(expected).items()
    }
    for text in texts.values():
        report = json.loads(text)
        assert list(report["declared_sources"]) == sorted(report["declared_sources"])


def test_sarif_report(audited):
    _, result, expected = audited
    texts = assembled(reports.sarif_report(result, "tool", "https://example.org/t"), "pos")
    assert set(texts) == set(reported(expected))
    for project, text in texts.items():
        document = json.loads(text)
        assert (document["version"], len(document["runs"])) == ("2.1.0", 1)
        run, findings = document["runs"][0], expected[project]["findings"]
        driver = run["tool"]["driver"]
        assert (driver["name"], driver["informationUri"]) == ("tool", "https://example.org/t")
        ids = sorted({f[0] for f in findings})
        assert [r["id"] for r in driver["rules"] or []] == ids
        assert driver["rules"] is None or ids
        for rule in driver["rules"] or []:
            assert rule["helpUri"] == f"https://example.org/t#{rule['name']}"
        keys = [(r["ruleId"], r["message"]["text"]) for r in run["results"]]
        assert keys == sorted(keys) and len(keys) == len(findings)
        got = []
        for entry in run["results"]:
            assert driver["rules"][entry["ruleIndex"]]["id"] == entry["ruleId"]
            assert entry["level"] == ("error" if entry["ruleId"] in ("ENV002", "ENV005") else "warning")
            path = line = None
            if "locations" in entry:
                place = entry["locations"][0]["physicalLocation"]
                path, line = place["artifactLocation"]["uri"], place["region"]["startLine"]
            source = entry.get("properties", {}).get("declared_source")
            got.append((entry["ruleId"], entry["message"]["text"].split(":")[0], path, line, source))
        assert sorted(got, key=str) == findings


def test_sarif_orders_by_message_and_the_others_by_variable(spark):
    files = files_of(spark, {"Dockerfile": "FROM x", "a.js": "process.env.A1 process.env.A process.env.A_"})
    result = scan(files, env_files_of(spark, {".env": ""})).pinned()
    results = reports.sarif_results(result).where("rule_id = 'ENV002'").orderBy("pos")
    assert [r.variable for r in results.collect()] == ["A1", "A", "A_"]
    lines = [r.text for r in reports.text_report(result).orderBy("line_no").collect()]
    assert lines[:4] == ["Used but not declared:", "- A (a.js:1)", "- A1 (a.js:1)", "- A_ (a.js:1)"]


CLEAN = {
    "version": "2.1.0",
    "$schema": reports.SARIF_SCHEMA,
    "runs": [
        {
            "tool": {"driver": {"name": "envtally", "informationUri": reports.TOOL_URI, "rules": None}},
            "results": [],
        }
    ],
}


def descriptor(rule_id, name, text):
    uri = f"{reports.TOOL_URI}#{name}"
    return {"id": rule_id, "name": name, "shortDescription": {"text": text}, "helpUri": uri}


def entry(rule_id, index, level, text, path=None, line=None, source=None):
    result = {"ruleId": rule_id, "ruleIndex": index, "level": level, "message": {"text": text}}
    if path:
        place = {"artifactLocation": {"uri": path}, "region": {"startLine": line}}
        result["locations"] = [{"physicalLocation": place}]
    if source:
        result["properties"] = {"declared_source": source}
    return result


def test_a_document_with_all_rules(spark):
    files = files_of(
        spark, {"src/app.go": '\nos.Getenv("GONE")', "Dockerfile": "FROM x\nENV IDLE=1\nRUN $LOST"}
    )
    result = scan(files, env_files_of(spark, {".env": "SPARE=1"}))
    unused = "Variable is declared in .env but not used in code"
    missing = "Variable is used in code but not declared in .env"
    nowhere = "Variable is used in code but not declared in Dockerfile or .env"
    idle = "Variable is declared in Dockerfile but not used in code"
    lost = "Variable is used in Dockerfile but not declared"
    document = json.loads(assembled(reports.sarif_report(result), "pos")["p"])
    assert document["runs"][0]["tool"]["driver"]["rules"] == [
        descriptor("ENV001", "unused-variable", unused),
        descriptor("ENV002", "missing-variable", missing),
        descriptor("ENV003", "code-uses-not-in-docker", nowhere),
        descriptor("ENV004", "docker-declares-unused", idle),
        descriptor("ENV005", "docker-uses-undeclared", lost),
    ]
    assert document["runs"][0]["results"] == [
        entry("ENV001", 0, "warning", f"SPARE: {unused}", source=".env"),
        entry("ENV002", 1, "error", f"GONE: {missing}", "src/app.go", 2),
        entry("ENV003", 2, "warning", f"GONE: {nowhere}", "src/app.go", 2),
        entry("ENV004", 3, "warning", f"IDLE: {idle}"),
        entry("ENV005", 4, "error", f"LOST: {lost}", "Dockerfile", 3),
    ]
    assert list(document) == ["version", "$schema", "runs"]


def test_a_clean_project(spark):
    files = files_of(spark, {"a.js": "process.env.A"})
    result = scan(files, env_files_of(spark, {".env": "A=1"})).pinned()
    assert rows(result.gate) == [("p", 0)]
    assert json.loads(assembled(reports.sarif_report(result), "pos")["p"]) == CLEAN
    assert rows(reports.text_report(result), "line_no", "text") == [(1, reports.NO_MISMATCH)]
    report = json.loads(assembled(reports.json_report(result), "section", "item", "part")["p"])
    assert report["unused"] == [] and report["missing"] == [] and report["declared_sources"] == {"A": ".env"}
    assert report["dockerfile_issues"] == {
        "code_uses_not_in_docker": [], "docker_declares_unused": [], "docker_uses_undeclared": []
    }


def test_clean_text_line_stays_when_only_dockerfiles_have_findings(spark):
    files = files_of(spark, {"Dockerfile": "FROM x\nENV A=1\nRUN $B"})
    result = scan(files, env_files_of(spark, {".env": ""}))
    assert [r[1] for r in rows(reports.text_report(result), "line_no", "text")] == [
        reports.NO_MISMATCH, "", "Dockerfile declares but code doesn't use:", "- A", "",
        "Dockerfile uses undeclared variables:", "- B (Dockerfile:3)",
    ]


def test_later_env_files_win_and_env_only_projects_are_reported(spark):
    env = env_files_of(spark, {".env": "A=1\nB=1", ".env.local": "A=2", "x": None})
    files = files_of(spark, {"readme.md": "nothing"}, project="no env")
    result = scan(files, env)
    assert rows(result.findings, "rule_id", "variable", "declared_source") == [
        ("ENV001", "A", ".env.local"), ("ENV001", "B", ".env")
    ]
    assert rows(result.gate) == [("no env", 2), ("p", 1)]
    assert rows(result.summary) == [("p", 0, 2, 0, 2)]
    assert rows(result.warnings) == [("p", "x", "env", "unreadable")]


def test_more_languages(spark):
    ruby = {**DEFAULT_PATTERNS, ".rb": [r"ENV\['([A-Z_]+)'\]"]}
    texts = {"a.rb": "ENV['A'] ENV['B']", "b.rb": None, "Dockerfile.rb": None, "c.js": "process.env.C"}
    result = scan(files_of(spark, texts), env_files_of(spark, {".env": "B=1"}), patterns=ruby)
    assert rows(result.findings.where("rule_id = 'ENV002'"), "variable", "path") == [("A", "a.rb"), ("C", "c.js")]
    assert rows(result.warnings, "path", "stage") == [
        ("Dockerfile.rb", "dockerfile"), ("Dockerfile.rb", "dockerfile"), ("b.rb", "source")
    ]
    assert result.summary.first()["files_scanned"] == 5


def test_paths_and_names_are_escaped_in_json(spark):
    files = files_of(spark, {'a"b\\c\t<é>/x.js': "process.env.A"}, project='q"')
    env = env_files_of(spark, {'e"\\': "B=1"}, project='q"')
    result = scan(files, env).pinned()
    report = json.loads(assembled(reports.json_report(result), "section", "item", "part")['q"'])
    assert report["missing"][0]["locations"][0]["FilePath"] == 'a"b\\c\t<é>/x.js'
    assert report["declared_sources"] == {"B": 'e"\\'}
    run = json.loads(assembled(reports.sarif_report(result), "pos")['q"'])["runs"][0]
    uri = run["results"][1]["locations"][0]["physicalLocation"]["artifactLocation"]["uri"]
    assert uri == 'a"b\\c\t<é>/x.js'
    windows = reports.sarif_report(result, windows_paths=True)
    run = json.loads(assembled(windows, "pos")['q"'])["runs"][0]
    uri = run["results"][1]["locations"][0]["physicalLocation"]["artifactLocation"]["uri"]
    assert uri == 'a"b/c\t<é>/x.js'


def test_write_reports(spark, tmp_path):
    files = files_of(spark, {f"{n}.js": "process.env.V" + str(n) for n in range(50)}, project="a/b")
    result = scan(files, env_files_of(spark, {".env": "X=1"}, project="a/b")).pinned()
    for kind in ("text", "json", "sarif"):
        reports.write_reports(result, str(tmp_path / kind), kind)
        [directory] = [p for p in (tmp_path / kind).iterdir() if p.is_dir()]
        parts = sorted(p for p in directory.iterdir() if p.name.startswith("part-"))
        text = "".join(p.read_text() for p in parts)
        if kind == "text":
            assert text.split("\n")[:4] == ["Declared but unused:", "- X", "", "Used but not declared:"]
            assert text.count("\n- V") == 100
        elif kind == "json":
            assert [m["variable"] for m in json.loads(text)["missing"]] == sorted(f"V{n}" for n in range(50))
        else:
            assert len(json.loads(text)["runs"][0]["results"]) == 101
    with pytest.raises(ValueError, match="xml"):
        reports.write_reports(result, str(tmp_path / "xml"), "xml")
    with pytest.raises(Exception, match="exist"):
        reports.write_reports(result, str(tmp_path / "text"), "text")


def test_reports_are_put_together_from_the_manifest(spark, tmp_path):
    """A report of several files, one of a single file, and a name that looks like a number."""
    files = files_of(spark, {f"{n}.js": f"process.env.V{n}" for n in range(400)}, project="big")
    files = files.unionByName(files_of(spark, {"a.js": "process.env.A"}, project="007"))
    env = env_files_of(spark, {".env": "X=1"}, project="big").unionByName(env_files_of(spark, {".env": ""}, project="007"))
    result = scan(files, env).pinned()
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for kind in ("json", "sarif"):
            path = str(tmp_path / kind)
            reports.write_reports(result, path, kind)
            listed = reports.read_manifest(spark, path).orderBy("project", "part").collect()
            texts = defaultdict(str)
            for row in listed:
                part = tmp_path / kind / f"project={row.project}" / row.file_name
                assert part.stat().st_size == row.bytes
                texts[row.project] += part.read_text()
            assert set(texts) == {"big", "007"} and len(listed) > 3
            documents = {project: json.loads(text) for project, text in texts.items()}
            if kind == "json":
                assert len(documents["big"]["missing"]) == 400 and len(documents["007"]["missing"]) == 1
            else:
                assert len(documents["big"]["runs"][0]["results"]) == 801
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_options_of_scans_do_not_mix(spark):
    """Expressions are built once for equal options only."""
    files = files_of(spark, {"a.js": "process.env.A\n" + "x" * 70000, "gen/b.js": "process.env.B", "c.rb": "ENV['C']"})
    env = env_files_of(spark, {".env": ""})
    ruby = {**DEFAULT_PATTERNS, ".rb": [r"ENV\['([A-Z_]+)'\]"]}

    def used(**options):
        return {r[0] for r in rows(scan(files, env, **options).findings, "variable")}

    for _ in range(2):
        assert used() == {"A", "B"}
        assert used(ignore="gen") == {"A"}
        assert used(max_line_bytes=65536) == {"B"}
        assert used(patterns=ruby) == {"A", "B", "C"}


def test_counts_come_with_the_variables(spark):
    """The gate needs two shuffles, whatever it counts."""
    files = files_of(spark, {"a.js": "process.env.A", "b/readme.md": ""})
    gate = scan(files, env_files_of(spark, {".env": "A=1"})).gate
    assert rows(gate) == [("p", 0)]
    plan = gate._jdf.queryExecution().sparkPlan().toString()
    executed = gate._jdf.queryExecution().executedPlan().toString()
    assert executed.split("Initial Plan")[0].count("Exchange hashpartitioning") <= 2 and "Join" not in plan
