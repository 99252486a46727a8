"""Operators over text corpora, pages and vectors; nothing else in the library imports this package."""
