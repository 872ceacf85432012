"""Operators of a training-data pipeline over whole document, page and conversation tables.

Nothing outside this package imports it. Each module holds one operator; `queries` registers them.
"""
