"""Column expressions: text, vectors, rules."""
