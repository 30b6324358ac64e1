"""Column expressions: no joins, no aggregation, no Python workers."""
