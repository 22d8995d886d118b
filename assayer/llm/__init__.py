"""Training-data operators: deduplication, token accounting, scoring, search and archives.

Nothing outside this subpackage imports it.
"""
