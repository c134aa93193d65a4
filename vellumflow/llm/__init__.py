"""Operators for building training data at corpus scale.

Nothing outside this package imports it, so it can be removed as a whole.
Every operator takes and returns DataFrames; the registered queries live in
:mod:`vellumflow.llm.queries`.
"""
