"""Corpus packing, document structure, review state and event logs on Spark."""
