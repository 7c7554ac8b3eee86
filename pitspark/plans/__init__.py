"""Named queries: each one is a composition of operators over the base tables."""
