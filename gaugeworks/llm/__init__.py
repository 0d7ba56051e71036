"""Operators for training-data corpora: cleaning, fingerprints, sharding, archives, tokens.

Nothing outside this subpackage imports it.
"""
