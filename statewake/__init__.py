"""Behaviour-graph analytics on Spark DataFrames."""
