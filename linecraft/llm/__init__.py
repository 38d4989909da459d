"""Training-data operators: scoring, near-duplicate search, mixing and cleaning of documents.

Nothing else in the library imports this package.
"""
