"""Operators of a training-data pipeline: sharding, search, scoring, packing, deduplication.

Nothing outside this package imports it; ``corpus_pipeline.py`` belongs to it.
"""
