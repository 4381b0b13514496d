"""Streaming forms of the queue, rate limit and presence logic."""
