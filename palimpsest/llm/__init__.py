"""Training-data operators: deduplication, quality, mixing, token output and more.

Nothing outside this package imports it; ``entries.py`` lists its queries.
"""
