"""Column builders: every function takes and returns `Column`s, no Python UDFs."""
