"""Operators for preparing training data: filters, classifiers, near-duplicates, packing and archives.

Nothing else in the library imports this subpackage.
"""
