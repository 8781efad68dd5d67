"""Operators for preparing language-model training data.

Nothing else in the library imports this subpackage.  Every operator takes and
returns DataFrames; the contract queries are in :mod:`docveil.llm.queries`.
"""
