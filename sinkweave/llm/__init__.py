"""Training-data operators: deduplication, mixing, filtering, extraction, tokenisation.

Nothing outside this subpackage imports it. Every operator takes and returns DataFrames; the
registered queries (``queries.py``) are thin views over them.
"""
