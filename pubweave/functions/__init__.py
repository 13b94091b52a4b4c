"""Column expressions and vocabulary."""
