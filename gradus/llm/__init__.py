"""Operators that prepare text corpora for training language models.

Nothing outside this subpackage imports it.  Each module holds one operator with its own general interface and the
thin query that applies it to the given tables; ``queries`` gathers them.
"""
