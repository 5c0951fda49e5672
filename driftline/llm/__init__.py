"""Operators of a large training-data pipeline.

Nothing else in driftline imports this subpackage; it may be left out.
"""
