"""Operators of a training-data pipeline over large text tables.  Nothing else in the library imports them."""
