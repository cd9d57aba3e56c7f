"""Row-local Column expressions (no shuffles)."""
