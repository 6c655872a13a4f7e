"""Brindle: code-signal extraction, ranked retrieval and their statistics on Spark DataFrames."""
