"""Operators for preparing training corpora, each a job over DataFrames.

Nothing else in the library imports this subpackage.
"""
