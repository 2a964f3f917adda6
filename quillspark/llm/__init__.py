"""Operators that prepare text for language-model training.

Nothing else in the library imports this subpackage.  Each module holds one
operator with its own general interface; :mod:`quillspark.llm.queries` holds the
thin registered queries and :mod:`quillspark.llm.oracles` their SQL.
"""
