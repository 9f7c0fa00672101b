"""Streaming forms of the log operators. Each has a batch twin in ``operators.rollups``."""
