"""Operators of a large training-data pipeline: text in, decisions, spans, files or scores out."""
