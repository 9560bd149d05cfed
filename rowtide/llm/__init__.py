"""Operators for building training corpora.

Nothing outside this subpackage imports it.  Each module holds one operator;
``queries`` registers one query for each of them.
"""
