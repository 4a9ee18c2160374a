"""The audit of one project, in plain Python and line by line, to test against."""

from __future__ import annotations

import re
from collections import defaultdict

WS = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
BLANK = "[\t\n\f\r ]"
NAME = "[A-Z][A-Z0-9_]*"
CODE = {
    "js": [rf"process\.env\.({NAME})", rf'process\.env\["({NAME})"\]', rf"process\.env\['({NAME})'\]"],
    "go": [rf'os\.Getenv\("({NAME})"\)', rf'os\.LookupEnv\("({NAME})"\)'],
    "py": [rf'os\.getenv\("({NAME})"\)', rf'os\.environ\["({NAME})"\]', rf"os\.environ\['({NAME})'\]"],
}
CODE["ts"] = CODE["js"]


def raw_lines(content):
    pieces = content.split("\n")
    return pieces[:-1] if pieces[-1] == "" else pieces


def physical(content):
    return [p[:-1] if p.endswith("\r") else p for p in raw_lines(content)]


def logical(content):
    done, open_line = [], ""
    for line in physical(content):
        bare = line.rstrip(" \t")
        if bare.endswith("\\"):
            open_line += bare[:-1] + " "
        else:
            done.append(open_line + line)
            open_line = ""
    return done + [open_line] if open_line else done


def oversize(content, limit):
    return any(len(p.encode()) >= limit for p in raw_lines(content))


def fields(text):
    return [f for f in re.split(f"[{WS}]+", text) if f]


def env_keys(content):
    for line in physical(content):
        line = line.strip(WS)
        match = re.match(rf"({NAME}){BLANK}*=", line)
        if match and not line.startswith("#"):
            yield match.group(1)


def code_uses(path, content):
    for number, line in enumerate(physical(content), 1):
        for pattern in CODE[path.rsplit(".", 1)[1]]:
            for match in re.finditer(pattern, line):
                yield match.group(1), number


def significant(content):
    for number, line in enumerate(logical(content), 1):
        line = line.strip(WS)
        if line and not line.startswith("#"):
            yield number, line


def docker_facts(content):
    """(declared names, [(used name, line)])"""
    lines = list(significant(content))
    if not any(re.match(rf"(?i)FROM{BLANK}", line) for _, line in lines):
        return set(), []
    declared, used = set(), []
    for number, line in lines:
        if match := re.match(rf"(?i)ENV{BLANK}+([^\n]+)", line):
            rest = match.group(1).strip(WS)
            if "=" in rest:
                keys = [f.split("=", 1)[0] for f in fields(rest) if f.find("=") > 0]
            else:
                keys = fields(rest)[:1]
            declared.update(k for k in keys if re.fullmatch(NAME, k))
        if match := re.match(rf"(?i)ARG{BLANK}+([^\n]+)", line):
            rest = match.group(1).strip(WS)
            key = rest[: rest.find("=")].strip(WS) if rest.find("=") > 0 else rest
            if re.fullmatch(NAME, key):
                declared.add(key)
        seen = dict.fromkeys(m.group(1) for m in re.finditer(rf"\$\{{?({NAME})", line))
        used += [(name, number) for name in seen]
    return declared, used


def audit(files, env_files, ignore=(), limit=65536):
    """files: [(path, content)], env_files: [(path, content)] in order; contents may be None."""
    warnings, declared, readable = [], {}, 0
    for path, content in env_files:
        if content is None or oversize(content, limit):
            warnings.append((path, "env", "unreadable" if content is None else "oversize"))
            continue
        readable += 1
        declared.update(dict.fromkeys(env_keys(content), path))
    if not readable:
        return {"gate": 2, "warnings": warnings}

    scanned, code, docker_declared, docker_used = 0, defaultdict(list), set(), defaultdict(list)
    for path, content in sorted(files, key=lambda f: f[0].split("/")):
        *directories, base = path.split("/")
        if {".git", "node_modules", "vendor", *ignore} & set(directories):
            continue
        ext = base.rsplit(".", 1)[1] if "." in base else ""
        is_docker = base.startswith("Dockerfile") or ext == "dockerfile"
        times = is_docker + (ext in CODE)
        scanned += times
        if not times:
            continue
        if content is None or oversize(content, limit):
            reason = "unreadable" if content is None else "oversize"
            warnings += [(path, "dockerfile" if is_docker else "source", reason)] * times
        elif is_docker:
            names, uses = docker_facts(content)
            docker_declared |= names
            for name, line in uses:
                docker_used[name].append((path, line))
        else:
            found = defaultdict(list)
            for name, line in code_uses(base, content):
                found[name].append((path, line))
            for name, places in found.items():
                code[name] += sorted(places)

    findings = [("ENV001", v, None, None, declared[v]) for v in declared if v not in code]
    findings += [("ENV002", v, *code[v][0], None) for v in code if v not in declared]
    findings += [
        ("ENV003", v, *code[v][0], None) for v in code if v not in declared and v not in docker_declared
    ]
    findings += [("ENV004", v, None, None, None) for v in docker_declared if v not in code]
    findings += [("ENV005", v, *docker_used[v][0], None) for v in docker_used if v not in docker_declared]
    return {
        "gate": 1 if findings else 0,
        "warnings": warnings,
        "summary": (scanned, len(declared), len(code), len(findings)),
        "findings": sorted(findings, key=str),
        "locations": {v: places for v, places in code.items()},
        "declared": declared,
    }


def text_report(result):
    by_rule = defaultdict(list)
    for rule, variable, path, line, _ in result["findings"]:
        by_rule[rule].append((variable, f"- {variable} ({path}:{line})" if path else f"- {variable}"))
    items = {rule: [text for _, text in sorted(rows)] for rule, rows in by_rule.items()}
    blocks = []
    if not items.get("ENV001") and not items.get("ENV002"):
        blocks.append(["No environment mismatches found."])
    for rule, heading in (
        ("ENV001", "Declared but unused:"),
        ("ENV002", "Used but not declared:"),
        ("ENV003", "Code uses variables not in Dockerfile or .env:"),
        ("ENV004", "Dockerfile declares but code doesn't use:"),
        ("ENV005", "Dockerfile uses undeclared variables:"),
    ):
        if items.get(rule):
            blocks.append([heading, *items[rule]])
    return "\n\n".join("\n".join(block) for block in blocks).split("\n")


def json_report(result):
    found = defaultdict(list)
    for rule, variable, path, line, _ in sorted(result["findings"], key=lambda f: (f[0], f[1])):
        found[rule].append((variable, {"FilePath": path, "LineNumber": line}))

    def with_locations(rule):
        return [
            {
                "variable": v,
                "locations": [{"FilePath": p, "LineNumber": n} for p, n in result["locations"][v]],
            }
            for v, _ in found[rule]
        ]

    scanned, declared, used, mismatches = result["summary"]
    return {
        "summary": {
            "files_scanned": scanned,
            "variables_declared": declared,
            "variables_used": used,
            "mismatches_found": mismatches,
        },
        "unused": [v for v, _ in found["ENV001"]],
        "missing": with_locations("ENV002"),
        "declared_sources": result["declared"],
        "dockerfile_issues": {
            "code_uses_not_in_docker": with_locations("ENV003"),
            "docker_declares_unused": [v for v, _ in found["ENV004"]],
            "docker_uses_undeclared": [{"variable": v, "location": at} for v, at in found["ENV005"]],
        },
    }
