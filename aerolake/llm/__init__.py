"""Operators of a training-data pipeline: scans, scoring, deduplication, archives, tokens, chats."""
