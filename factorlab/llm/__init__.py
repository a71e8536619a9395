"""Training-data operators: filtering, de-duplication, redaction and packing of text corpora.

Nothing else in the library imports this subpackage.
"""
