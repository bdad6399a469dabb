"""Bank-statement reconciliation as Spark jobs over statement lines, ledger movements, documents and links."""
