"""Compositions of operators: ingestion, search, and the catalogue of named queries."""
