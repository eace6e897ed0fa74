"""The checked queries: inputs derived from the given tables, queries, oracle SQL."""
