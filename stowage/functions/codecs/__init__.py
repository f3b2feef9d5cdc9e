"""Encoding and decoding of items, a module for each format."""
