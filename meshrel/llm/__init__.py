"""Training-data operators: dedup, quality, language, toxicity, tokenizing and packing.

Self-contained: the rest of the library never imports this subpackage.
"""
