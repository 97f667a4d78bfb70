"""Whole pipelines and the inputs derived from the driver tables."""
