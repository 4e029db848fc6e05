"""Axioms that arrive over time."""
