"""Corpora over the given tables, the registered queries and their SQL counterparts."""
