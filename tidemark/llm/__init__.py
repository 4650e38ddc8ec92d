"""Training-data operators: extraction, tokens, search, filters, deduplication.

Nothing outside this subpackage imports it.  Every operator takes and returns
DataFrames; ``queries.py`` holds the thin registered queries.
"""
