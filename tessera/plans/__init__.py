"""Execution helpers shared by operators."""
