"""Operators for building training data from a corpus of documents.

Nothing outside this folder imports it.  ``catalog`` holds the registered
queries and their SQL.
"""
