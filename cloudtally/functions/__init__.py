"""Column expressions: money, dates, tags, labels, JSON values."""
