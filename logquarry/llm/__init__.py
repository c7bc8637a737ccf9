"""Operators of a training-data pipeline: filters, de-duplication, decontamination, scoring and mixing of text tables.

Every operator takes DataFrames and returns DataFrames; ``queries`` binds each to its whole table. Nothing else in
the library imports this package.
"""
