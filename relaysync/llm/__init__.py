"""Operators of a training-data pipeline (see README, section llm).

Nothing else in the library imports this subpackage.
"""
