"""Operators for preparing training data at scale.

Nothing else in the library imports this subpackage.  Queries and their SQL
are in ``entries``; each operator has a module of its own.
"""
