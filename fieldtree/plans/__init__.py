"""Compositions of operators, the queries and their SQL."""
