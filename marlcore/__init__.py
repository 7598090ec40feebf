"""Marlcore: clustering, graph, statistics and table operators declared on PySpark DataFrames."""
