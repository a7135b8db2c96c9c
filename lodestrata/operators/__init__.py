"""Operators over the catalogue of references, entries and tasks."""
