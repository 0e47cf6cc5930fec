"""Operators for large training-data pipelines.

Every module here stands alone: nothing else in the library imports this
subpackage.  ``queries.py`` holds the thin registered queries.
"""
