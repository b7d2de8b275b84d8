"""Corpus analytics with provenance on Spark."""
