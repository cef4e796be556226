"""Operators for preparing training text: filters, deduplication, mixing, packing, rendering.

Nothing outside this folder imports it, apart from the guarded lines of ``__spark_entry__.py``.
"""
