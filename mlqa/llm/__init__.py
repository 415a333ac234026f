"""Operators for building large language-model training corpora.

One module per operator; ``catalog`` registers one query per operator. Nothing
outside this folder (and ``corpus_pipeline.py``) imports it.
"""
