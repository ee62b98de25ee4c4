"""Operators for preparing language-model training corpora at scale.

Nothing outside this subpackage imports it.  Every operator is a plain module
with its own general interface; :mod:`brindle.llm.queries` wraps each one in a
thin registered query.
"""
