"""Column expressions: predicates, text, times."""
