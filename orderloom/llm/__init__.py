"""Operators of a training-data pipeline: search, filtering, de-duplication, mixing and packing of texts."""
