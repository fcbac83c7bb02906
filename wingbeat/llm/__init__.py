"""Operators for preparing training text: scoring, searching, cleaning and mixing of documents."""
