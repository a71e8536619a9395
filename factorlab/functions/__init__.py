"""Column expressions, dense numerics and matrix SQL."""
