"""Statement files as lines: readers take a path or a table of (file, content)."""
