"""Predicates, projections, star joins and aggregates on DataFrames."""
