"""Structured Streaming forms of the change log and of the lease sweep."""
