"""Streaming of libsight."""
