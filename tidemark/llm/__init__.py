"""Operators for preparing training data, and their queries (``queries.py``).

Nothing else in the library imports this package.
"""
