"""Relational operators of the graph engine."""
