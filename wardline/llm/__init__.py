"""Operators for building training corpora. Nothing outside this subpackage, its tests and corpus_pipeline.py imports it."""
