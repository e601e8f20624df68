"""Column functions: metapaths, predicates and metrics."""
