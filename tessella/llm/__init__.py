"""Operators of a training-data pipeline over text tables.

Nothing else in the library imports this subpackage.  Every operator is a
function from DataFrames to a DataFrame; ``registry.py`` holds the queries that
apply them to whole tables.
"""
