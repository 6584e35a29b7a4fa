"""Operators of a training-data pipeline: quality, fingerprints, chat, tokens, urls, personal data, mixing, near copies, lines."""
