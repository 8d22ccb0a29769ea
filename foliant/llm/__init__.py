"""Operators for training-data pipelines.

Nothing outside this package imports it, so it can be removed as a whole.
"""
