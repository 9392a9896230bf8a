"""Column expressions: geometry of ellipses, windows, statistics."""
