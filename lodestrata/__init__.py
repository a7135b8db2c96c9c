"""Content-addressed data and provenance analytics on PySpark."""
