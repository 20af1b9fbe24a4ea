"""Operators for preparing sequences and texts for language models. Nothing else in the library imports this."""
