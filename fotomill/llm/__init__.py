"""Operators for training data: near duplicates, survivorship, components, tokens, packing and splitting."""
