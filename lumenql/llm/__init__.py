"""Training-data operators: tokenizers, classifiers, filters and deduplication at corpus scale.

Nothing outside this package imports it; it imports nothing of the rest of the library.
"""
