"""Reading, writing and result handling."""
