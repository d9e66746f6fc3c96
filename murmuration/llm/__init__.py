"""Operators for large-scale training-data preparation (one module per operator).

``queries`` registers them; nothing outside this subpackage imports it except the driver entry.
"""
