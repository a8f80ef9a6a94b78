"""Column expressions: paths, text and token estimates."""
