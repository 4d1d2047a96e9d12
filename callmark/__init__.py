"""Benchmarking of variant calls on Spark DataFrames."""
