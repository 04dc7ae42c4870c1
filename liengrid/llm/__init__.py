"""Operators for training-data pipelines: search, deduplication, filters, tokens, language models."""
