"""Operators for preparing training corpora: deduplication, packing, scoring, mixing, archives.

Every operator is a function of DataFrames; the registered queries live in ``queries``.
"""
