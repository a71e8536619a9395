"""Structured Streaming: sufficient statistics of samples as they arrive."""
