"""Operators of a training-data pipeline, each a module; their registered queries are in ``queries``."""
