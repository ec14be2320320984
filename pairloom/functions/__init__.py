"""Column functions: each takes and returns Columns, so it works in batch and stream."""
