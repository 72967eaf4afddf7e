"""Operators of a training-data pipeline: one module each, their queries in ``queries``.

Nothing else in the library imports this package.
"""
