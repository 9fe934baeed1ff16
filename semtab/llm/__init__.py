"""Operators of a training-data pipeline: language, quality, copies, leaks, mixing, personal data, urls, tokens."""
