"""Operators that prepare text and media for training; nothing else in the library imports them."""
