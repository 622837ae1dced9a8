"""Functions of libsight."""
