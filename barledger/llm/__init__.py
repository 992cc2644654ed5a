"""Operators of a training-data pipeline: extraction, labelling, filtering, deduplication, mixing, packing, media."""
