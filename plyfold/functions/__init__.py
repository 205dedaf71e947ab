"""Column expressions: scalar codecs, quoting, references, token estimates."""
