"""Operators of a training-data pipeline; nothing outside this package and its queries imports it."""
