"""Training-data operators: fingerprints, dedup, packing, quality, archives, language and tokens.

Nothing outside this subpackage imports it.
"""
