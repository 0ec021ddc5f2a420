"""Operators for large text corpora: duplicates, tokens, languages, quality, filters and search."""
