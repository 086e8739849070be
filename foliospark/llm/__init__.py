"""Operators for training data: text repair, deduplication, language, subjects, token ids. Nothing outside imports this package."""
