"""Operators that a large training-data pipeline needs.

Each module holds one operator with a general interface and, below it, the
thin ``opN_*`` query over the ``documents`` table.  Nothing outside this
subpackage imports it.
"""
