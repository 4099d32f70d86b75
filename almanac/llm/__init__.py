"""Operators for preparing training data.

Nothing outside this subpackage imports it; ``queries.py`` holds the catalogue
entries and their SQL.
"""
