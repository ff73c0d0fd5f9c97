"""Operators on DataFrames of chunks, tokens, mentions, classes and triples."""
