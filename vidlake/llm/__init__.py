"""Operators over training texts: cleaning, linking, packing and sharding of whole corpora."""
