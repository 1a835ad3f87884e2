"""Operators of a training-data pipeline: text, vector and page tables to clean, mixed, sharded, encoded ones.

Nothing outside this subpackage imports it.
"""
