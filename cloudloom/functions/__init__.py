"""Column expressions and byte codecs."""
