"""Causal inference on Spark DataFrames."""
