"""Readers and writers: knowledge-graph records, matrices, result files, and the driver's tables as a graph."""
