"""Column functions: text, references, numbers, dates and identities."""
