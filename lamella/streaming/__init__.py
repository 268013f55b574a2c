"""Structured Streaming forms of the batch builders."""
