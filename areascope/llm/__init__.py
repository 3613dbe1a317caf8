"""Training-data operators: filters, classifiers, near-duplicate search and mixing.

Nothing else in the library imports this subpackage.
"""
