"""Operators of a training-data pipeline: quality, decontamination, toxicity, extraction, dedup, counts, language, mixing, joins."""
