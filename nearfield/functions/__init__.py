"""Column functions over array vectors."""
