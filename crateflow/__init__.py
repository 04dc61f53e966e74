"""Operators for music libraries, performance data and the corpora around them, as Spark DataFrames."""
