"""Operators for large training-data pipelines. Nothing else in yardspark imports this subpackage."""
