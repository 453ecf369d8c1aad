"""Operators on the engine's tables."""
