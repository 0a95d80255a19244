"""Operators of a training-data pipeline: one module for each, queries in `queries`.

Nothing outside this folder imports it; `__spark_entry__.py` adds its queries where the folder exists.
"""
