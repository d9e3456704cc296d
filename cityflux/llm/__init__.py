"""Operators of a training-data pipeline over documents, conversations, pages and vectors.

Nothing else in the library imports this subpackage; it imports only general helpers from it.
"""
