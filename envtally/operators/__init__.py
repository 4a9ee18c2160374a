"""Relational operators: lines, facts, reconciliation, ordering."""
