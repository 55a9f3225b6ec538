"""Training-data operators: one module per operator, queries in ``queries.py``, stages in ``corpus_pipeline.py``."""
