"""Readers that build layered graphs, and writers of results."""
