"""Operators for large-scale training-data preparation, apart from the rest of the library."""
