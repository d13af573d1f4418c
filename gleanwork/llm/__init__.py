"""Training-data operators: filtering, deduplication, scoring, packing and archiving of text corpora.

Nothing else in the library imports this subpackage.
"""
