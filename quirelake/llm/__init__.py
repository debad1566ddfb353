"""Operators on the text of documents and titles."""
