"""Operators of a training-data pipeline over `documents`-like tables.

Nothing outside this subpackage imports it. Each module holds one operator with a general
interface; `queries.py` holds the thin contract queries and their SQL.
"""
