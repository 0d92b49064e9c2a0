"""Topological analysis of scalar fields on regular grids, on Spark."""
