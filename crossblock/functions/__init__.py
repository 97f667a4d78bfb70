"""Column-level building blocks: they never shuffle."""
