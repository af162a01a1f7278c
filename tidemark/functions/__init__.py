"""Column expressions: labels, matchers, time."""
