"""Column matchers: each takes a catalog and returns predictions."""
