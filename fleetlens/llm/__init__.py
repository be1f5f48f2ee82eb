"""Operators of a training-data pipeline, each with its own general interface; ``queries`` applies them to the tables."""
