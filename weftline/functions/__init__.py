"""Column expressions: no data is read or moved here."""
