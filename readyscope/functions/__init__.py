"""Column expressions: predicates, rates and label formatting."""
