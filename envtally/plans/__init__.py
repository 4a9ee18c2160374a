"""Whole audits and their reports."""
