"""Operators for building training corpora.

Nothing outside this package imports it.  Each operator has a module of its own;
``queries`` registers the thin queries and ``words`` and ``common`` hold what
several operators share.
"""
