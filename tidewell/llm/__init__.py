"""Corpus operators for training data: scoring, scanning, near-copy removal, tokenising.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
