"""The five rules."""

from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    rule_id: str
    name: str
    level: str
    description: str


# Ids, names, levels and messages of the findings.
RULES = (
    Rule("ENV001", "unused-variable", "warning", "Variable is declared in .env but not used in code"),
    Rule("ENV002", "missing-variable", "error", "Variable is used in code but not declared in .env"),
    Rule("ENV003", "code-uses-not-in-docker", "warning", "Variable is used in code but not declared in Dockerfile or .env"),
    Rule("ENV004", "docker-declares-unused", "warning", "Variable is declared in Dockerfile but not used in code"),
    Rule("ENV005", "docker-uses-undeclared", "error", "Variable is used in Dockerfile but not declared"),
)
