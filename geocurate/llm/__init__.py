"""Operators for corpora of training text, with their queries and SQL.

Nothing else in the library imports this subpackage.
"""
