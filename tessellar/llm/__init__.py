"""Operators for large-scale training-data pipelines.

Nothing outside this subpackage imports it. Each module holds one operator with a
general interface; :mod:`tessellar.llm.registry` binds the operators to the tables.
"""
