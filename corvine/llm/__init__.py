"""Operators for training text: splitting, pairing, packing, mixing, repair and vector search."""
