"""Metapath overlap analytics on a typed property graph, expressed with Spark DataFrames."""
