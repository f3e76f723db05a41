"""Operators for large text-training corpora.

Nothing outside this subpackage imports it.  Each module holds one operator
with its own general interface; ``queries`` derives the digest columns of the
registered queries from them.
"""
