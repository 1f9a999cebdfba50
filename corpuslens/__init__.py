"""Catalogue and preview large collections of files and documents with Spark."""
