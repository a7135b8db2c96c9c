"""Column functions: references, text lines, formats, hashes and codecs."""
