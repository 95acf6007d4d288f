"""Operators composed to whole pipelines."""
