"""Operators for large-scale training-data preparation.

Each module holds one operator with a general interface; ``queries`` binds them
to the driver tables.  Nothing else in the library imports this subpackage.
"""
