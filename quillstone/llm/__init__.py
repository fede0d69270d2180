"""Operators for preparing language-model training corpora.

Nothing outside this subpackage imports it.  Every module holds one operator with a
general interface and, at its end, the thin ``opN_<name>`` query that applies it to the
synthetic tables.
"""
