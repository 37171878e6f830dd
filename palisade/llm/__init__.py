"""Operators of a training-data pipeline and the queries that apply them; nothing else in the library imports them."""
