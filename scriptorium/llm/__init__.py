"""Operators for preparing training text.

Nothing outside this package imports it, so it can be removed as a whole.
Every operator takes a DataFrame and names of its key and text columns and
returns a DataFrame; rows whose text is null are treated as empty text.
"""
