"""Operators: DataFrame in, DataFrame out, keyed by ``doc_id``."""
