"""Column functions: tokens, numbers as text, literal casts, text splitting and n-gram hashes."""
