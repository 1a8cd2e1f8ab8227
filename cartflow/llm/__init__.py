"""Operators for building language-model training data.

Ten operators over ``documents``, ``pages``, ``conversations`` and
``embeddings``; each module states its method, its results on odd input
and what it shuffles.  Nothing outside this package imports it except
the entry point, which works without it.
"""
