"""Column expressions: check digits, patterns, context predicates, normalisation and span arrays."""
