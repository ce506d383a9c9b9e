"""Operators for large-scale training-data pipelines.

Nothing outside this subpackage imports it. Each module holds one operator with its own
general interface; :mod:`strandset.llm.queries` derives the registered queries from them.
"""
