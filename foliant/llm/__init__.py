"""Corpus-scale operators for preparing training data; nothing outside imports this package."""
