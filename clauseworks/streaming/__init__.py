"""Streams. The engine's tables arrive in batches; these helpers take the same rows as they come."""
