"""Operators for preparing text corpora. Nothing outside this folder imports it."""
