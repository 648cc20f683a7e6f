"""Where tables' rows live: read-only Parquet, and versioned snapshots."""
