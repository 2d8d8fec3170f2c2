"""Structured Streaming forms of the windowing, gating and alarm operators."""
