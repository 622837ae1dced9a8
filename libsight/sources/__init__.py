"""Sources of libsight."""
