"""Operators of a training-data pipeline.  Each module is one operator; ``queries.py`` applies them to the tables."""
