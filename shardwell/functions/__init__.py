"""Column expressions: NULL-aware comparison, paths, buckets."""
