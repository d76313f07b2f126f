"""Column expressions: text semantics, report parsing, geometry, scoring."""
