"""Operators that prepare training text: archives, deduplication, classifiers, packing, token files.

Nothing else in the library imports this subpackage.
"""
