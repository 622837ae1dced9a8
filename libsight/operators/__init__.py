"""Operators of libsight."""
