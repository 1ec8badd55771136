"""Operators for preparing text for training, and the queries that apply them."""
