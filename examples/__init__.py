"""Example programs over the engine."""
