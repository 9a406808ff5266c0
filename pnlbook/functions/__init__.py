"""Column-level helpers: exact decimal ratios and display text."""
