"""Column functions: keys, text and definition text."""
