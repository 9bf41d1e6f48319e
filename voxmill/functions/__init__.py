"""Column expressions and helpers that operators share."""
