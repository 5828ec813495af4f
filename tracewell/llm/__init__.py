"""Operators for large text corpora: scoring, de-duplication, packing, formats."""
