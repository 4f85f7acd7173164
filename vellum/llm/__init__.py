"""Training-data operators: deduplication, language, privacy, packing, scoring.

Nothing outside this subpackage imports it.
"""
