"""Operators of a training-data pipeline over `documents`, `pages`, `benchmark` and `labels`.

Each module holds one operator and its thin registered query.  Nothing else in the library imports this package.
"""
