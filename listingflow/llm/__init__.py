"""Operators for training corpora: each takes and gives DataFrames; nothing else in the library imports them."""
