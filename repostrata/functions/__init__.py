"""Column-level functions and predicates."""
