"""Operators: search, validation, result checks, study analytics."""
