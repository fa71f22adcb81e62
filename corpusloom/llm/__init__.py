"""Operators for large training-data pipelines; nothing else in corpusloom imports this package."""
