"""Operators for large-scale training-data preparation.

Nothing outside this subpackage imports it; removing it leaves the analytics engine intact.
"""
