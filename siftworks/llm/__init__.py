"""Training-data operators: ten document-scale operators and their queries.

Nothing else in the package imports this subpackage, so it can be removed
together with ``tests/llm`` and ``corpus_pipeline.py``.
"""
