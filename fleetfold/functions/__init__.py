"""Column expressions: strict JSON fields, identifiers, rule chains, text and geometry."""
