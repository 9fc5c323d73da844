"""Operators of a training-data pipeline; see ``queries`` for what each returns."""
