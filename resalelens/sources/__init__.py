"""Readers of captured pages and state, and writers of results."""
