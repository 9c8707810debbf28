"""Column functions. All of them are native expressions; there are no Python UDFs here."""
