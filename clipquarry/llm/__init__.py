"""Training-data operators: one module per operator, plus the queries that apply them.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it.
"""
