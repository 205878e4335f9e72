"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it; ``tidemark.llm.entry`` lists its
queries for ``__spark_entry__.py``.
"""
