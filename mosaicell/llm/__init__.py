"""Operators for preparing language-model training corpora at cluster scale.

Nothing outside this subpackage imports it; the query registry lives in
``mosaicell.llm.registry``.
"""
