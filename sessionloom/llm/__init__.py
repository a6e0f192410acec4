"""Operators for large-scale training-data pipelines.

Each module holds one operator with its own general interface and a thin
``query`` that applies it to the driver's tables.  Nothing outside this
subpackage imports it; ``registry`` lists its queries.
"""
