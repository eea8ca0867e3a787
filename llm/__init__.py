"""Operators of a training-data pipeline. Nothing else in the repository imports this package."""
