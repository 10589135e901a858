"""Operators of a training-data pipeline.

Every module holds one operator with a general interface plus the thin query
that applies it to a whole table.  Nothing outside this package imports it.
"""
