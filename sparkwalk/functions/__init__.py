"""Column expressions: scalars and geometry."""
