"""Whole workflows built from the operators, and the queries that show them."""
