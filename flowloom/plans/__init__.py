"""Compositions of operators and the named queries."""
