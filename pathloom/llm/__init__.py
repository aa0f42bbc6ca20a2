"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it; ``corpus_pipeline.py`` and the
guarded block of ``__spark_entry__.py`` are its only users.
"""
