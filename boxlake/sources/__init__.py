"""Readers and writers for documents, listings and Parquet tables."""
