"""Training-data operators: corpus cleaning, deduplication, mixing, tokenizing, archives.

Nothing else in the library imports this package. ``catalogue`` registers one query
per operator; ``corpus_pipeline.py`` at the repository top chains five of them.
"""
