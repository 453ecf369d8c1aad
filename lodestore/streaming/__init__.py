"""Continuous work on the tables."""
