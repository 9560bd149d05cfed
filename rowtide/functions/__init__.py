"""Scalar functions and row codecs."""
