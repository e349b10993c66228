"""Column expressions: parsing, scales, tails, models."""
