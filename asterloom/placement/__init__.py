"""Placement simulation: cost model, segment cache, query streams."""
