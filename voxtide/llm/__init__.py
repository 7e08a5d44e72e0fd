"""Operators for preparing training data: quality rules, deduplication, mixing, packing, archives.

Nothing outside this subpackage imports it; each operator has its own module, the registered queries and
their SQL are in `queries`.
"""
