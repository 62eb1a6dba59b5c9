"""Queries and whole jobs built from the operators."""
