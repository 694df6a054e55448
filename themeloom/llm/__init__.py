"""Operators for preparing training data, each a function from DataFrame to DataFrame."""
