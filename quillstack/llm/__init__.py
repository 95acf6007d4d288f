"""Training-data pipeline operators.

Nothing else in the library imports this subpackage; it can be deleted
together with ``corpus_pipeline.py`` and ``tests/llm``.
"""
