"""Bibliographic catalogue analytics as DataFrame, SQL and Structured Streaming plans."""
