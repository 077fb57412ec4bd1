"""Declarative queries and the star queries."""
