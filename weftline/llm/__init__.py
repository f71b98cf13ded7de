"""Operators of a training-data pipeline over text and vectors.

Nothing outside this subpackage imports it.
"""
