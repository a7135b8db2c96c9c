"""Training-data operators: extraction, filtering, deduplication, scoring and mixing of text."""
