"""Operators for large training-data corpora.

Nothing else in the library imports this subpackage.  Each module holds one operator with a general
interface; ``queries`` registers one query per operator over the test tables.
"""
