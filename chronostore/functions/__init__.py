"""Column expressions and windows that the operators share."""
