"""Column expressions: regression metrics and report formats."""
