"""Relational operators on keyed tables and data directories."""
