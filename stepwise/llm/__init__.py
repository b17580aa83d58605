"""Training-data operators: dedup, search, mixing, archives, tokens, classifiers.

Nothing outside this package imports it.  Every operator takes and returns
DataFrames; ``queries.py`` registers one query for each.
"""
