"""Column expressions: text, identifiers, vectors."""
