"""Operators of a training-data pipeline: packing and framing of token ids,
quality rules, near-duplicate detection, language identification, language
model scoring, toxicity, source mixing and URL filtering.

Nothing else in the package imports this subpackage.
"""
