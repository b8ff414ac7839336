"""Structured Streaming: the same operators, advanced block by block."""
