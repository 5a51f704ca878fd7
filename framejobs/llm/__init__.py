"""Operators of a training-data pipeline: deduplication, selection, mixing, packing and token output."""
