"""Column expressions and small argument helpers."""
