"""Operators of a training-data pipeline, by the methods named in the README."""
