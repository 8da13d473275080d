"""Column-level building blocks (predicates, math, strings, global order)."""
