"""Values, ranges and regular expressions: what schemas are made of."""
