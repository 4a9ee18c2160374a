"""Audit of the configuration variables of many projects, on Spark."""

from envtally.functions.names import DEFAULT_PATTERNS
from envtally.plans.scan import ScanResult, scan

__all__ = ["DEFAULT_PATTERNS", "ScanResult", "scan"]
