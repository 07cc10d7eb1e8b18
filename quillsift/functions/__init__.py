"""Column expressions: cleaning, tokens and the 29 per-document features."""
