"""Operators on DataFrames: index, lexical, retrieval, provenance, entities, series."""
