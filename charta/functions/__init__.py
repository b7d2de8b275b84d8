"""Column expressions for text, markup, addresses and names."""
