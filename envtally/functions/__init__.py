"""Column expressions: names, paths, text and JSON helpers."""
