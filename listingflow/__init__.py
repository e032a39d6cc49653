"""Incremental analytics over listing-like records, as DataFrame operators."""
