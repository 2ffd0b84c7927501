"""Column expressions: exact ratios and averages, mergeable measures, fixed labels."""
