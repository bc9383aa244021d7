"""Operators for training-data pipelines (documents, pages, benchmark sets).

Nothing outside this folder and ``corpus_pipeline.py`` imports it.
"""
